"""Connected components of links between 64-bit keys, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` for each node of `links` (a long, b long): the smallest node reachable.

    Each round every node of the contracted graph hooks to its smallest neighbour (itself
    included); the chains of hooks are shortened to their roots by doubling; links are
    rewritten to roots and equal ones merged, until none is left. A node with very many
    links costs a minimum, combined before the shuffle; no neighbourhood is gathered.
    Every round's tables are written, so that a lost executor costs one step.
    """
    links = stored(
        links.where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    known = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select("b", "a"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        hooks = hooks.select("node", F.least("node", "b").alias("root"))
        hooks = _to_roots(stored(hooks, "hooks"))
        known = hooks if known is None else _relabelled(known, hooks)
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = links.join(left, "a").join(right, "b").where("ra != rb")
        links = stored(
            moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links"
        )
    if known is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return known


def _to_roots(hooks: DataFrame) -> DataFrame:
    """Every node's root: hooks go to smaller nodes, so chains end; each round halves them."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = hooks.join(up, "root").select("node", F.col("root").alias("was"), F.col("top").alias("root"))
        hooks = stored(jumped, "hooks")
        if hooks.where("was != root").isEmpty():
            return hooks.select("node", "root")
        hooks = hooks.select("node", "root")


def _relabelled(known: DataFrame, hooks: DataFrame) -> DataFrame:
    """Roots that have hooked on in this round are replaced by what they hooked to."""
    up = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return stored(
        known.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots"
    )
