"""Sharding by a hierarchical weighted hash tree.

A tree has three levels: regions, their racks, their shards. A key descends it: at each
level every child draws -ln(u) / weight, u from a hash of the key and of the child's own
name, and the smallest draw wins; a child's weight is the sum of its shards' weights.
A child wins in proportion to its weight, and draws of children whose weight did not
change stay as they were. So when a weight grows, keys move only into the grown child,
and when it shrinks only out of it, level by level; other subtrees keep their keys.

Everything is built-in expressions: no shuffle to place rows, one to number them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.llm.common import stored, whole_text

#: Shards of a rack and racks of a region in `default_tree`.
RACK, REGION = 2, 2


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def default_tree(shards: int) -> list[Leaf]:
    """`shards` equal shards, two to a rack, two racks to a region.

    With a multiple of four shards the next shard opens a region of its own, so that it
    takes keys only into itself.
    """
    return [
        Leaf(f"region{n // (RACK * REGION)}", f"rack{n // RACK}", n) for n in range(shards)
    ]


def _checked(leaves: Iterable[Leaf]) -> list[Leaf]:
    leaves = list(leaves)
    if not leaves:
        raise ValueError("a tree needs a shard")
    if len({leaf.shard for leaf in leaves}) != len(leaves):
        raise ValueError("a shard may occur once")
    if any(not (0 < leaf.weight < math.inf) for leaf in leaves):
        raise ValueError("weights must be positive numbers")
    return leaves


def draw(key: Column, node: str, weight: float) -> Column:
    """The node's draw for the key: exponential with the weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(node), key), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(2.0**53)) / F.lit(float(weight))


def _descend(key: Column, nodes: dict[str, tuple[float, Column]]) -> Column:
    """The value of the child that wins; equal draws go to the first child."""
    if len(nodes) == 1:
        return next(iter(nodes.values()))[1]
    draws = [(draw(key, name, weight), value) for name, (weight, value) in nodes.items()]
    least = F.least(*(d for d, _ in draws))
    chosen = F
    for d, value in draws:
        chosen = chosen.when(d == least, value)
    return chosen


def shard_of(key: Column, leaves: Iterable[Leaf]) -> Column:
    """The shard of a key. A null key is a key like any other."""
    tree: dict[str, dict[str, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for leaf in _checked(leaves):
        tree[leaf.region][leaf.rack].append(leaf)
    key = F.coalesce(key.cast("string"), F.lit("\x00null"))
    regions = {}
    for region, racks in tree.items():
        inner = {}
        for rack, own in racks.items():
            shards = {
                f"shard/{region}/{rack}/{x.shard}": (x.weight, F.lit(x.shard)) for x in own
            }
            weight = sum(x.weight for x in own)
            inner[f"rack/{region}/{rack}"] = (weight, _descend(key, shards))
        weight = sum(w for w, _ in inner.values())
        regions[f"region/{region}"] = (weight, _descend(key, inner))
    return _descend(key, regions)


def assign(
    docs: DataFrame,
    leaves: Iterable[Leaf],
    grown: Iterable[Leaf] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Each row's shard by its id: id, size, text_crc32, law, shard, slot, grown_shard.

    `size` is the text's UTF-8 bytes plus one, `slot` numbers the rows of a shard from 0
    without gaps, `grown_shard` is the shard in the tree `grown` (null without one).

    Null ids share one key. Null texts have size 1 and the checksum of no bytes. Repeated
    rows and repeated ids go to one shard, each with a slot of its own. An empty table
    gives no rows. Other columns of the input are ignored, whatever their names.

    Rows are numbered inside the part of the input they were read in, and parts' counts
    give each part its first slot: no shard's rows meet in one task. The counts have a row
    for each part and shard; they are joined by sums over parts of one shard, of which
    there are as many as input splits. The placed rows are written once before they are
    counted, so that a task that runs again cannot number them otherwise.
    """
    text = whole_text(F.col(text_column))
    key = F.col(id_column)
    here = F.monotonically_increasing_id()
    placed = stored(
        docs.select(
            key.alias(id_column),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            shard_of(key, leaves).alias("shard"),
            (F.lit(None).cast("int") if grown is None else shard_of(key, grown)).alias("grown_shard"),
            F.shiftright(here, 33).alias("__part"),
            here.alias("__row"),
        ),
        "sharding",
    )
    group = ["shard", "__part"]
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        placed.groupBy(*group)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    )
    inside = Window.partitionBy(*group).orderBy("__row")
    return (
        placed.withColumn("__slot", F.row_number().over(inside).cast("long") - 1)
        .join(first, group)
        .select(
            id_column,
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("__first") + F.col("__slot")).alias("slot"),
            "grown_shard",
        )
    )
