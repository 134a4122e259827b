"""Sharding: the laws of the slots, of weights, and of movement."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hydroframe.llm import sharding
from hydroframe.llm.sharding import Leaf

SCHEMA = "doc_id long, text string, shard string, slot string"


def test_slots_sizes_and_growth(spark):
    rows = [(n, f"é{n}" * (n % 5), "x", "y") for n in range(3000)]
    rows += [(None, None, None, None)] * 2 + [(7, "é7é7", "x", "y")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.assign(docs, sharding.default_tree(16), sharding.default_tree(17)).collect()
    assert len(got) == len(rows)
    for shard, n in Counter(r.shard for r in got).items():
        assert 0 <= shard < 16
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
        assert 130 < n < 260
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert 110 < sum(r.grown_shard == 16 for r in got) < 250
    texts = {(r[0], r[1]) for r in rows}
    want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == want
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_movement_stays_in_changed_subtrees(spark):
    old = sharding.default_tree(8)
    new = [Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 2 else 1.0) for x in old]
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    rows = ids.select(
        sharding.shard_of(F.col("doc_id"), old).alias("a"),
        sharding.shard_of(F.col("doc_id"), new).alias("b"),
    ).collect()
    place = {x.shard: (x.region, x.rack) for x in old}
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved
    for a, b in moved:
        if place[a][0] != place[b][0]:
            assert place[b][0] == place[2][0]  # into the grown region only
        elif place[a][1] != place[b][1]:
            assert place[b][1] == place[2][1]  # into the grown rack only
        else:
            assert b == 2
    share = Counter(r.b for r in rows)[2] / len(rows)
    assert abs(share - 0.3) < 0.04


def test_empty_table_and_wrong_trees(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.assign(docs, sharding.default_tree(4)).collect() == []
    for leaves in ([], [Leaf("r", "k", 1), Leaf("r", "k", 1)], [Leaf("r", "k", 1, 0.0)]):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit(1), leaves)
