"""Station lists and series catalogs: selection, name checks, map points, spans."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.cells import number_cell


def stations_of(stations: DataFrame, states: DataFrame, on: Column | str | list) -> DataFrame:
    """Stations whose state is requested."""
    return stations.join(states, on, "left_semi")


def stations_with(stations: DataFrame, value: str, column: str = "site_no") -> DataFrame:
    """Stations with the given number, or with another column of the given value."""
    return stations.where(F.col(column) == value)


def name_check(stations: DataFrame, pattern: str, name: str, keys: list[str]) -> DataFrame:
    """Per key the number of rows and whether every name matches the pattern."""
    return stations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col(name).rlike(pattern)).alias("ok")
    )


def point_layer(stations: DataFrame, lat: str = "dec_lat_va", lon: str = "dec_long_va") -> DataFrame:
    """Stations for a map: coordinates as numbers, rows complete in every column."""
    numbers = {c: number_cell(F.col(c).cast("string")) for c in (lat, lon)}
    return stations.withColumns(numbers).dropna("any")


def series_span(df: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """Per key the period of record and the number of rows."""
    return df.groupBy(*keys).agg(
        F.min(begin).alias("begin"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")
    )


def profile(df: DataFrame) -> DataFrame:
    """Number of rows and of non-null cells per column, in one row."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count(c).alias(c) for c in df.columns))


def schema_table(df: DataFrame) -> DataFrame:
    """Column names and types as a table."""
    return df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)],
        "position int, name string, type string",
    )


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in the given order."""
    return df.orderBy(*order).limit(n)
