"""Quality rules: statistics against a plain count, learning, held-out accuracy, odd rows."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from hydroframe.llm import quality_rules as Q
from hydroframe.llm.workload import op5_quality_rules


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def texts():
    rng = random.Random(3)
    words = ["a", "b", "the", "né", "x#y", "Ω", "😀", "|", "A B"]
    made = ["", None, " \n\t\x0b\x0c\r", "a a a a", "a b a b a", "one two", "l\nl\n\n \nl\r\nm"]
    made += [" ".join(rng.choices(words, k=rng.randrange(200))) for _ in range(60)]
    made += ["\n".join(" ".join(rng.choices(words, k=4)) for _ in range(30)) for _ in range(10)]
    made += [" ".join(f"w{rng.randrange(40)}" for _ in range(20000)), "w " * 30000, "long" * 50000]
    return made


def test_statistics_equal_a_plain_count(spark):
    made = texts()
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    docs = docs.withColumn("q", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("row", F.lit(2))
    got = Q.judge(docs, []).select("row.doc_id", *(f"q.{n}" for n in Q.BASE), "base_failed", "kept")
    for r in got.collect():
        want = plain(made[r.doc_id])
        assert tuple(r)[1:6] == want, made[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op5_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(tuple(r)[1:6] == plain(docs[r.doc_id]) for r in got)


def test_learned_list_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    rules = Q.train(docs, train)
    held = docs.join(labels.where("doc_id % 2 = 1 and quality is not null"), "doc_id")
    rows = Q.judge(held, rules).where(~F.col("base_failed")).select("row.quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert np.mean(good) > 0.995
    assert np.mean(bad) < 0.05


def test_covering_finds_conjunctions_and_prunes():
    rng = np.random.default_rng(1)
    values = rng.random((3000, 3))
    bad = (values[:, 0] > 0.8) & (values[:, 1] < 0.4) | (values[:, 2] > 0.95)
    rules = Q.learn(values, bad, ["x", "y", "z"])
    caught = np.zeros(len(values), dtype=bool)
    for rule in rules:
        caught |= Q._covers(rule, values, ["x", "y", "z"])
    assert (caught & ~bad).sum() < 0.01 * len(values)
    assert (caught & bad).sum() > 0.9 * bad.sum()
    assert Q.learn(values, rng.random(3000) < 0.1, ["x", "y", "z"]) == []  # noise: no rule holds


def test_nothing_to_learn_and_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.train(docs, labels) == []
    assert Q.judge(docs, []).collect() == []
    assert Q.learn(np.ones((5, 1)), np.ones(5, dtype=bool), ["x"]) == []


def test_a_labelled_id_counts_once(spark, monkeypatch):
    """An id on very many rows brings one row to the driver; repeated labels are one, the worse."""
    learned = []
    monkeypatch.setattr(Q, "learn", lambda values, bad, names: learned.append((len(values), bad.tolist())) or [])
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.range(3000).selectExpr("id % 3 as doc_id", f"concat('{text} ', id) as text")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 1), (1, 1), (None, 0), (2, None), (9, 0)], "doc_id long, quality int")
    Q.train(docs, labels)
    assert [(n, sorted(bad)) for n, bad in learned] == [(2, [False, True])]
