"""Which stored keys are stale, and from when they have to be fetched again."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.times import day_text, lifetime
from hydroframe.operators.observations import HISTORY_START


def is_stale(fetched_at: Column, ttl: str, now: Column) -> Column:
    """Never fetched, or fetched longer ago than the lifetime."""
    return F.coalesce(now - fetched_at > lifetime(ttl), F.lit(True))


def newest_fetch(rows: DataFrame, keys: list[str], fetched_at: str = "fetched_at") -> DataFrame:
    return rows.groupBy(*keys).agg(F.max(fetched_at).alias("fetched_at"))


def any_part_stale(
    parts: DataFrame, keys: list[str], ttl: str, now: Column, fetched_at: str = "fetched_at"
) -> DataFrame:
    """Per key whether any of its parts is stale; then all parts are computed again."""
    return parts.groupBy(*keys).agg(
        F.min(fetched_at).alias("fetched_at"),
        F.bool_or(is_stale(F.col(fetched_at), ttl, now)).alias("stale"),
    )


def freshness(
    requested: DataFrame, marks: DataFrame, keys: list[str], ttl: str, now: Column
) -> DataFrame:
    """Requested keys with their marks and whether they are stale, absent ones included.

    `marks` has one row per key with `fetched_at`.
    """
    return requested.join(marks, keys, "left").withColumn(
        "stale", is_stale(F.col("fetched_at"), ttl, now)
    )


def stale_split(
    requested: DataFrame, fresh: DataFrame, keys: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Requested keys that can be reused and those that have to be computed."""
    return requested.join(fresh, keys, "left_semi"), requested.join(fresh, keys, "left_anti")


def high_water_mark(rows: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Per key the latest moment."""
    return rows.groupBy(*keys).agg(F.max(time).alias("high_water"))


def refetch_since(requested: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Per requested key the day to fetch from: its last day, or the start of history."""
    since = F.coalesce(day_text(F.col("high_water")), F.lit(HISTORY_START))
    return requested.join(marks, keys, "left").select(*requested.columns, since.alias("since"))
