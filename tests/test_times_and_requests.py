"""Date texts, request plans and small station operators."""

from datetime import datetime

from pyspark.sql import functions as F

from hydroframe.functions import times
from hydroframe.operators import stations
from hydroframe.plans import requests


def now():
    return F.lit("2021-11-03 10:00:00").cast("timestamp_ntz")


def test_date_texts(spark):
    df = spark.createDataFrame(
        [("2021-10-15", "1997-12-18"), ("", "1997"), ("soon", "2021-01-01"), ("2020-05-05", "2020-05-05")],
        "s string, e string",
    )
    first, last = times.ordered_days(F.col("s"), F.col("e"), now())
    got = df.select(first, last, times.year_of(F.col("s"), now()), times.safe_day_text(F.col("s")))
    assert [tuple(r) for r in got.collect()] == [
        ("1997-12-18", "2021-10-15", 2021, "2021-10-15"),
        ("1997-01-01", "2021-11-03", 2021, ""),
        (None, None, None, ""),
        ("2020-05-05", "2020-05-05", 2020, "2020-05-05"),
    ]


def test_one_request_per_year(spark):
    sites = spark.createDataFrame([("01",), ("02",)], "site_no string")
    plan = requests.yearly_requests("http://h", sites, F.lit("2021-11-03"), F.lit("2019-12-18"), now())
    got = [(r.site_no, r.year, r.url) for r in plan.orderBy("site_no", "year").collect()]
    assert [g[:2] for g in got] == [(s, y) for s in ("01", "02") for y in (2019, 2020, 2021)]
    assert got[0][2] == (
        "http://h/iv/?format=rdb,1.0&sites=01&startDT=2019-01-01&endDT=2019-12-31&siteStatus=all"
    )


def test_open_end_leaves_the_parameter_out(spark):
    df = spark.createDataFrame([("01", ""), ("02", None), ("03", "2021-10-30")], "s string, e string")
    got = df.select(requests.values_url("b", F.col("s"), F.lit("1900-01-01"), F.col("e"))).collect()
    assert [r[0] for r in got] == [
        "b/iv/?format=rdb,1.0&sites=01&startDT=1900-01-01&siteStatus=all",
        "b/iv/?format=rdb,1.0&sites=02&startDT=1900-01-01&siteStatus=all",
        "b/iv/?format=rdb,1.0&sites=03&startDT=1900-01-01&endDT=2021-10-30&siteStatus=all",
    ]


def test_point_layer_needs_every_column(spark):
    df = spark.createDataFrame(
        [("a", "38.04", "-122.1", "x"), ("b", "unknown", "1", "x"), ("c", "1", "2", None)],
        "site_no string, dec_lat_va string, dec_long_va string, note string",
    )
    assert [tuple(r) for r in stations.point_layer(df).collect()] == [("a", 38.04, -122.1, "x")]


def test_profile_and_schema(spark):
    df = spark.createDataFrame([(1, None), (2, datetime(2024, 1, 1))], "a int, b timestamp_ntz")
    assert tuple(stations.profile(df).first()) == (2, 2, 1)
    assert [tuple(r) for r in stations.schema_table(df).collect()] == [
        (0, "a", "int"), (1, "b", "timestamp_ntz"),
    ]
