"""Observations: long and wide form, time windows, last values."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.functions.cells import is_bad, number_cell, text_cell, time_cell
from hydroframe.sources.rdb import RdbText, position_in

# A value column is named <series>_<parameter>, or with a statistic
# <series>_<parameter>_<statistic>; its qualifier column has the suffix.
SERIES_COLUMN = r"^[0-9]+_[0-9]{5}(_[0-9]{5})?$"
QUALIFIER_SUFFIX = "_cd"
# Fixed value: the day histories are asked for from.
HISTORY_START = "1900-01-01"

SERIES_KEY = ("site_no", "ts_id", "parameter_cd", "statistic_cd", "datetime", "tz_cd")
CELL_COLUMNS = ("value", "raw", "qualifier")
# Rows of a parameter dictionary that is sent whole to every executor.
BROADCAST_ROWS = 20_000
# Columns of a file that have columns of their own in long form.
INDEX_COLUMNS = ("site_no", "datetime", "tz_cd")


def _series(names: Column) -> Column:
    """Per value column of a header: its ids and the places of value and qualifier."""
    return F.transform(
        F.filter(names, lambda name: name.rlike(SERIES_COLUMN)),
        lambda name: F.struct(
            F.split_part(name, F.lit("_"), F.lit(1)).alias("ts_id"),
            F.split_part(name, F.lit("_"), F.lit(2)).alias("parameter_cd"),
            F.nullif(F.split_part(name, F.lit("_"), F.lit(3)), F.lit("")).alias("statistic_cd"),
            position_in(names, name).alias("value_at"),
            position_in(names, F.concat(name, F.lit(QUALIFIER_SUFFIX))).alias("qualifier_at"),
        ),
    )


def _others(names: Column) -> Column:
    """Name and place of each column that is neither index, value nor qualifier."""
    qualifiers = F.transform(
        F.filter(names, lambda name: name.rlike(SERIES_COLUMN)),
        lambda name: F.concat(name, F.lit(QUALIFIER_SUFFIX)),
    )
    placed = F.transform(names, lambda name, at: F.struct(name.alias("name"), at.alias("at")))
    return F.filter(
        placed,
        lambda p: ~(
            p["name"].isin(*INDEX_COLUMNS)
            | p["name"].rlike(SERIES_COLUMN)
            | F.array_contains(qualifiers, p["name"])
        ),
    )


def long_observations(text: RdbText) -> DataFrame:
    """One row per data line and series, whatever series a file has.

    `raw` and `raw_time` keep cell and time as written, so that a token that is no number
    (`Ice`) or no time stays visible next to its null. `attributes` holds the line's other
    columns by name; null cells are left out. (file, block, line) tell where a row came from.
    """
    return _long(text)


#: Kinds of `routed_observations`.
PLACED, TIMELESS, REJECTED = "placed", "timeless", "rejected"


def routed_observations(text: RdbText) -> DataFrame:
    """`long_observations` and the lines that fit no header, in one pass, told apart by `kind`.

    `placed` rows have a time, `timeless` ones none that can be read; a `rejected` row stands for
    a line with more cells than columns and has it in `rejected`.
    """
    kind = F.when(F.col("rejected").isNotNull(), REJECTED).when(F.col("datetime").isNull(), TIMELESS)
    return _long(text, "rejected").withColumn("kind", kind.otherwise(PLACED))


def _long(text: RdbText, rejected_as: str | None = None) -> DataFrame:
    names = F.col("names")
    kept = [rejected_as] if rejected_as else []
    rows = text.rows(
        _series(names).alias("series"),
        _others(names).alias("others"),
        position_in(names, "site_no").alias("site_at"),
        position_in(names, "datetime").alias("time_at"),
        position_in(names, "tz_cd").alias("zone_at"),
        rejected_as=rejected_as,
    )
    time = F.get("cells", F.col("time_at"))
    cells = F.col("cells")
    named = F.transform(
        "others", lambda o: F.struct(o["name"].alias("key"), text_cell(F.get(cells, o["at"])).alias("value"))
    )
    # Cast what all series of a line share before the line is multiplied.
    shared = rows.select(
        "file", "block", "line", "cells", *kept, *text.carried,
        (F.when(F.col(rejected_as).isNull(), F.col("series")) if kept else F.col("series")).alias("series"),
        text_cell(F.get("cells", F.col("site_at"))).alias("site_no"),
        time_cell(time).alias("datetime"),
        text_cell(time).alias("raw_time"),
        text_cell(F.get("cells", F.col("zone_at"))).alias("tz_cd"),
        F.map_from_entries(F.filter(named, lambda n: n["value"].isNotNull())).alias("attributes"),
    )
    # explode would add a condition on `series` that is pushed down to the file scan
    # and takes each file apart a second time; explode_outer adds none.
    found = F.col("s").isNotNull()
    for name in kept:
        found |= F.col(name).isNotNull()
    each = shared.withColumn("s", F.explode_outer("series")).where(found)
    cell = F.get("cells", F.col("s.value_at"))
    return each.select(
        "site_no",
        "datetime",
        "tz_cd",
        F.col("s.ts_id").alias("ts_id"),
        F.col("s.parameter_cd").alias("parameter_cd"),
        F.col("s.statistic_cd").alias("statistic_cd"),
        number_cell(cell).alias("value"),
        text_cell(cell).alias("raw"),
        text_cell(F.get("cells", F.col("s.qualifier_at"))).alias("qualifier"),
        "attributes",
        "raw_time",
        "file",
        "block",
        "line",
        *text.carried,
        *kept,
    )


def unpivoted(df: DataFrame, ids: list[str], series: list[str]) -> DataFrame:
    """Wide to long for a table whose series columns are known: (ids, series, value)."""
    return df.unpivot(ids, series, "series", "value")


def wide_observations(
    long: DataFrame, rows: list[str], series: str, names: list[str], cell: Column
) -> DataFrame:
    """Long to wide: one column per listed series, `cell` aggregated in each."""
    return long.groupBy(*rows).pivot(series, names).agg(cell)


def bad_tokens(long: DataFrame) -> DataFrame:
    """Observations whose cell holds a token that is no number."""
    return long.where(is_bad(F.col("raw"), F.col("value")))


def timeless(long: DataFrame) -> DataFrame:
    """Observations without a time: the token, if there is one, cannot be read."""
    return long.where("datetime is null")


def with_parameters(observations: DataFrame, parameters: DataFrame, on: list[str]) -> DataFrame:
    """Observations next to the description of their series.

    One series may have most of the observations, so none of them is sorted: a task holds
    dictionary rows only. The dictionary grows with the stations. Up to `BROADCAST_ROWS` rows,
    which are counted first, it is broadcast and observations stay where they are; a larger one
    is dealt by `on`, and each task hashes its part.
    """
    small = parameters.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return observations.join(parameters.hint("broadcast" if small else "shuffle_hash"), on)


def _bound(bound: str | datetime | None) -> Column | None:
    if bound is None or bound == "":
        return None
    text = bound if isinstance(bound, str) else bound.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def moments(spark: SparkSession, *bounds: str | datetime | None) -> list[datetime | None]:
    """What the bounds mean, read as `in_window` reads them: any date text a cast takes, a date
    its midnight, an empty one open (None). Text that is no date is an error."""
    parsed = [_bound(b) for b in bounds]
    row = spark.range(1).select(
        *((F.lit(None) if p is None else p).cast("timestamp_ntz").alias(f"b{i}") for i, p in enumerate(parsed))
    )
    return list(row.first())


def in_window(
    df: DataFrame,
    start: str | datetime | None,
    end: str | datetime | None,
    time: str = "datetime",
) -> DataFrame:
    """Rows in the closed window; a date means its midnight, an empty bound is open."""
    first, last = _bound(start), _bound(end)
    if first is not None:
        df = df.where(F.col(time) >= first)
    if last is not None:
        df = df.where(F.col(time) <= last)
    return df


def full_history(df: DataFrame, time: str = "datetime") -> DataFrame:
    return in_window(df, HISTORY_START, None, time)


def select_series(df: DataFrame, column: str, wanted: str, *kept: str) -> DataFrame:
    """The kept columns of one series."""
    return df.where(F.col(column) == wanted).select(*kept)


def last_values(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Per key the latest moment and the value there."""
    return df.groupBy(*keys).agg(
        F.max_by(value, time).alias(value), F.max(time).alias(time)
    )
