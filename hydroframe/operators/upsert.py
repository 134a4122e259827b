"""Cell-level upsert: new cells win unless they are null; no row is ever removed."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_join(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert by one full outer join; keys must be unique within either side.

    The keys are compared null-safe, so an absent optional key column matches.
    """
    cells = _all_columns([new, old], keys)
    sides = {"new": new.columns, "old": old.columns}

    def newest(column: str) -> Column:
        holders = [F.col(f"{side}.`{column}`") for side, held in sides.items() if column in held]
        return F.coalesce(*holders).alias(column)

    same = reduce(
        lambda a, b: a & b, (F.col(f"new.`{k}`").eqNullSafe(F.col(f"old.`{k}`")) for k in keys)
    )
    joined = new.alias("new").join(old.alias("old"), same, "full")
    return joined.select(*(newest(c) for c in [*keys, *cells]))


def upsert_agg(
    frames: list[DataFrame],
    keys: list[str],
    order: list[str] = (),
    present: dict[str, str] | None = None,
) -> DataFrame:
    """Upsert of any number of frames, newest first, by one aggregation.

    Unlike the join it accepts repeated keys: within a frame the last row by `order`
    wins, cell by cell. Rows are combined before the shuffle. `present` names, for a
    column whose null is a finding of its own, the column that tells whether its cell
    is there: a number follows the raw token it was read from.
    """
    present = present or {}
    cells = _all_columns(frames, [*keys, *order])
    ranked = [
        df.select("*", F.lit(-i).alias("_rank")) for i, df in enumerate(frames)
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    place = F.struct("_rank", *order) if order else F.col("_rank")
    return union.groupBy(*keys).agg(
        *(
            F.max_by(c, F.when(F.col(present.get(c, c)).isNotNull(), place)).alias(c)
            for c in cells
        )
    )


#: The column that tells for each cell, by its name, who wrote it last.
WRITTEN = "written"


def stamped(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    stamp: list[str],
    present: dict[str, str] | None = None,
) -> DataFrame:
    """One row per key of rows that just came, with the last writer of each cell in `WRITTEN`.

    Of repeated keys the last row by `order` wins, cell by cell; `stamp`, the columns that
    `order` begins with, is what is kept of the winner's place.
    """
    if list(order[: len(stamp)]) != list(stamp):
        raise ValueError(f"the order {list(order)} does not begin with {list(stamp)}")
    present = present or {}
    cells = _all_columns([rows], [*keys, *order])
    there = {c: F.col(present.get(c, c)).isNotNull() for c in cells}
    merged = rows.groupBy(*keys).agg(
        *(F.max_by(c, F.when(there[c], F.struct(*order))).alias(c) for c in cells),
        *(F.max(F.when(there[c], F.struct(*stamp))).alias(f"_by_{i}") for i, c in enumerate(cells)),
    )
    return merged.select(*keys, *cells, _writers({c: F.col(f"_by_{i}") for i, c in enumerate(cells)}))


def upsert_stamped(frames: list[DataFrame], keys: list[str], present: dict[str, str] | None = None) -> DataFrame:
    """Upsert of frames of unique keys whose cells know their last writers: the later writer wins.

    The result does not depend on which frame came first, or on how rows were dealt into
    frames. A cell without a writer is older than any with one; between equal writers the
    first frame counts.
    """
    present = present or {}
    cells = _all_columns(frames, [*keys, WRITTEN])
    ranked = [df.select("*", F.lit(-i).alias("_rank")) for i, df in enumerate(frames)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    writer = {c: F.try_element_at(WRITTEN, F.lit(c)) for c in cells}
    there = {c: F.col(present.get(c, c)).isNotNull() for c in cells}
    merged = union.groupBy(*keys).agg(
        *(F.max_by(c, F.when(there[c], F.struct(writer[c], F.col("_rank")))).alias(c) for c in cells),
        *(F.max(F.when(there[c], writer[c])).alias(f"_by_{i}") for i, c in enumerate(cells)),
    )
    return merged.select(*keys, *cells, _writers({c: F.col(f"_by_{i}") for i, c in enumerate(cells)}))


def _writers(of: dict[str, Column]) -> Column:
    """Cell names to their writers; cells nobody wrote are left out."""
    entries = F.array(*(F.struct(F.lit(c).alias("key"), by.alias("value")) for c, by in of.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias(WRITTEN)


def _all_columns(frames: list[DataFrame], without: list[str]) -> list[str]:
    """Columns of all frames in order of appearance."""
    names = dict.fromkeys(c for df in frames for c in df.columns)
    return [c for c in names if c not in without]


def stacked_parts(parts: list[DataFrame]) -> DataFrame:
    """Several frames as one table that remembers which part a row came from."""
    numbered = [df.withColumn("part_idx", F.lit(i)) for i, df in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def parts_of(stacked: DataFrame, n: int) -> list[DataFrame]:
    """The n parts of `stacked_parts` again, in their order."""
    return [stacked.where(F.col("part_idx") == i).drop("part_idx") for i in range(n)]
