"""Upsert and freshness."""

import itertools
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings, strategies as st

from hydroframe.functions.times import lifetime_seconds
from hydroframe.operators import refresh, upsert

SCHEMA = "k int, z string, v double, q string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def both(spark, new, old):
    new, old = frame(spark, new), frame(spark, old)
    joined = upsert.upsert_join(new, old, ["k", "z"]).select("k", "z", "v", "q")
    grouped = upsert.upsert_agg([new, old], ["k", "z"]).select("k", "z", "v", "q")
    a, b = (sorted(map(tuple, df.collect()), key=repr) for df in (joined, grouped))
    assert a == b
    return a


OLD = [(1, "x", 1.0, "P"), (2, "x", 2.0, "P"), (3, None, 3.0, "P")]
NEW = [(2, "x", None, "A"), (3, None, 30.0, None), (4, "x", 40.0, "A")]


def test_cells(spark):
    assert both(spark, NEW, OLD) == sorted(
        [(1, "x", 1.0, "P"), (2, "x", 2.0, "A"), (3, None, 30.0, "P"), (4, "x", 40.0, "A")], key=repr
    )


def test_identities(spark):
    key = lambda rows: sorted(rows, key=repr)
    assert both(spark, NEW, []) == key(NEW)
    assert both(spark, [], OLD) == key(OLD)
    once = both(spark, NEW, OLD)
    assert both(spark, NEW, once) == once


cells = st.tuples(st.none() | st.floats(-9, 9), st.none() | st.sampled_from("PA"))
sides = st.dictionaries(st.tuples(st.integers(0, 4), st.none() | st.just("x")), cells)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(new=sides, old=sides)
def test_equals_cellwise_choice(spark, new, old):
    want = []
    for key in new.keys() | old.keys():
        cell = [a if a is not None else b for a, b in
                itertools.zip_longest(new.get(key, (None, None)), old.get(key, (None, None)))]
        want.append((*key, *cell))
    rows = lambda side: [(*k, *c) for k, c in side.items()]
    assert both(spark, rows(new), rows(old)) == sorted(want, key=repr)


def test_columns_are_united(spark):
    new = spark.createDataFrame([(1, 5)], "k int, a int")
    old = spark.createDataFrame([(1, 6), (2, 7)], "k int, b int")
    for df in (upsert.upsert_join(new, old, ["k"]), upsert.upsert_agg([new, old], ["k"])):
        assert sorted(map(tuple, df.select("k", "a", "b").collect())) == [(1, 5, 6), (2, None, 7)]


def test_repeated_keys_resolve_by_line_order(spark):
    rows = [(1, "x", 1.0, "P", 1), (1, "x", 2.0, None, 2), (1, "x", None, None, 3)]
    df = spark.createDataFrame(rows, SCHEMA + ", line int")
    got = upsert.upsert_agg([df], ["k", "z"], ["line"]).collect()
    assert [(r.v, r.q) for r in got] == [(2.0, "P")]


def test_number_follows_its_token(spark):
    new = spark.createDataFrame([(1, None, "Ice"), (2, None, None)], "k int, v double, raw string")
    old = spark.createDataFrame([(1, 5.0, "5"), (2, 6.0, "6")], "k int, v double, raw string")
    got = upsert.upsert_agg([new, old], ["k"], present={"v": "raw"}).orderBy("k").collect()
    assert [tuple(r) for r in got] == [(1, None, "Ice"), (2, 6.0, "6")]


def test_freshness_boundary(spark):
    now = datetime(2024, 1, 31, 12)
    marks = spark.createDataFrame(
        [("fresh", datetime(2024, 1, 31)), ("edge", datetime(2024, 1, 30, 12)),
         ("old", datetime(2024, 1, 30, 11, 59, 59))],
        "key string, fetched_at timestamp_ntz",
    )
    asked = spark.createDataFrame([(k,) for k in ("fresh", "edge", "old", "absent")], "key string")
    at = F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    got = refresh.freshness(asked, marks, ["key"], "1D", at)
    assert {r.key: r.stale for r in got.collect()} == {
        "fresh": False, "edge": False, "old": True, "absent": True,
    }
    reuse, compute = refresh.stale_split(asked, marks.where(~refresh.is_stale(F.col("fetched_at"), "1D", at)), ["key"])
    assert {r.key for r in reuse.collect()} == {"fresh", "edge"}
    assert {r.key for r in compute.collect()} == {"old", "absent"}


def test_any_part(spark):
    parts = spark.createDataFrame(
        [("a", 0, datetime(2024, 1, 31)), ("a", 1, datetime(2024, 1, 1)), ("b", 0, datetime(2024, 1, 31))],
        "key string, part_idx int, fetched_at timestamp_ntz",
    )
    now = F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")
    got = refresh.any_part_stale(parts, ["key"], "1D", now).collect()
    assert {r.key: (r.stale, r.fetched_at.day) for r in got} == {"a": (True, 1), "b": (False, 31)}


@pytest.mark.parametrize(
    "text, seconds", [("1D", 86400), ("1H", 3600), ("90min", 5400), ("1D 12h", 129600), ("30 s", 30)]
)
def test_lifetimes(text, seconds):
    assert lifetime_seconds(text) == seconds


@pytest.mark.parametrize("text", ["", "D", "1 fortnight", "1"])
def test_no_lifetimes(text):
    with pytest.raises(ValueError):
        lifetime_seconds(text)
