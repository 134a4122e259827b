"""Substring dedup against comparing all windows, and the automaton against all substrings."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hydroframe.llm import substring_dedup as D
from hydroframe.llm.workload import op7_substring_dedup


def plain(texts, window):
    split = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    found = []
    for words in split:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        found.append((len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return found


def made(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passages = [rng.choices(words, k=rng.randrange(30, 90)) for _ in range(6)]
    texts = [None, "", "a b", "x " * 200, "p q r " * 60, " ".join(words[:34]), "\n".join(words[:35])]
    for _ in range(n):
        text = rng.choices(words, k=rng.randrange(120))
        for passage in rng.sample(passages, rng.randrange(3)):
            at, cut = rng.randrange(len(text) + 1), rng.randrange(20)
            text[at:at] = passage[cut:]
        texts.append(rng.choice([" ", "\n", " \t"]).join(text))
        if rng.random() < 0.2:
            texts.append(texts[-1])
        if rng.random() < 0.3:
            texts.append(texts[-1] + " tail" + str(rng.random()))
    return texts


@pytest.mark.parametrize("window,group", [(35, 2000), (35, 3), (10, 2000), (10, 5)])
def test_equals_comparing_all_windows(spark, monkeypatch, window, group):
    monkeypatch.setattr(D, "GROUP", group)
    texts = made(window + group)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    docs = docs.withColumn("th", F.lit(1)).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: tuple(r)[1:] for r in D.remove_repeats(docs, window=window).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, window)


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op7_substring_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert [got[d.doc_id] for d in docs] == plain([d.text for d in docs], 35)


def test_automaton_gives_the_longest_repeated_run():
    rng = random.Random(4)
    for _ in range(150):
        texts = ["".join(rng.choices("ab", k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 5))]
        times = [rng.choice([1, 1, 2]) for _ in texts]
        automaton = D.Automaton()
        for text, n in zip(texts, times):
            automaton.add(text, n)
        automaton.finish()
        count = Counter()
        for text, n in zip(texts, times):
            for i in range(len(text)):
                for j in range(i, len(text)):
                    count[text[i : j + 1]] += n
        for text in [*texts, "abba", "cab"]:
            want = [
                max([k for k in range(1, i + 2) if count[text[i + 1 - k : i + 1]] > 1], default=0)
                for i in range(len(text))
            ]
            assert list(automaton.repeated(text)) == want


def test_rows_without_repeats(spark):
    texts = made(9)
    rows = [(n if n % 5 else None, t, len(t or ""), "x") for n, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string")
    got = D.without_repeats(docs, length_column="n_chars")
    assert got.schema.names == docs.schema.names and got.count() == len(rows)
    want = Counter(w[2] for w in plain(texts, 35))
    found = got.collect()
    assert Counter(hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() for r in found) == want
    assert all(r.n_chars == len(r.text or "") for r in found)
    assert Counter(r.text for r in found)[texts[4]] == 0 and Counter(r.text for r in found)["a b"] == 1
    for empty in (D.without_repeats(docs.limit(0)), D.remove_repeats(docs.limit(0))):
        assert empty.collect() == []
