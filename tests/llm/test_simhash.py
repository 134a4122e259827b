"""SimHash near duplicates against comparing all fingerprints, and the components of links."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hydroframe.llm import simhash as S
from hydroframe.llm.components import components
from hydroframe.llm.workload import op8_simhash


def plain_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(prints, distance):
    prints = sorted(set(prints))
    array, root = np.array(prints, dtype=np.uint64), {p: p for p in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n, p in enumerate(prints):
        for q in array[n:][np.bitwise_count(array[n:] ^ array[n]) <= distance].tolist():
            a, b = find(p), find(q)
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


def clustered(rng, n):
    made = []
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 3, 40])):
            made.append(base)
            for _ in range(rng.randrange(4)):
                base ^= 1 << rng.randrange(64)
    return made


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_dense_groups_are_compared_in_blocks(spark, monkeypatch):
    """All fingerprints of six bits share their other bits: one group at any level."""
    monkeypatch.setattr(S, "GROUP", 10)
    prints = [signed(0xABCDEF0123456789 ^ n) for n in range(64)]
    rows = spark.createDataFrame([(7, p) for p in prints], "key long, f long")
    dealt = S._in_blocks(rows, spark.createDataFrame([(7, 64)], "key long, n long"))
    groups = [set(r.fs) for r in dealt.groupBy("key").agg(F.collect_list("f").alias("fs")).collect()]
    assert len(groups) == 21 and max(map(len, groups)) < 45  # two of seven blocks each
    assert all(any({a, b} <= g for g in groups) for a in prints for b in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "f long")
    made = components(S.links(frame, 1)).collect()
    assert {r.node for r in made} == set(prints) and {r.root for r in made} == {min(prints)}


@pytest.mark.parametrize("distance,group", [(4, 4000), (4, 5), (1, 3), (6, 4)])
def test_links_reach_what_all_comparisons_reach(spark, monkeypatch, distance, group):
    monkeypatch.setattr(S, "GROUP", group)
    prints = sorted({signed(p) for p in clustered(random.Random(distance), 60)})
    frame = spark.createDataFrame([(p,) for p in prints], "f long")
    made = [tuple(r) for r in S.links(frame, distance).collect()]
    unsigned = {p: p % (1 << 64) for p in prints}
    assert all(bin(unsigned[a] ^ unsigned[b]).count("1") <= distance for a, b in made)
    want = plain_roots([unsigned[p] for p in prints], distance)
    got = {p: p for p in prints}
    linked = spark.createDataFrame(made, "a long, b long")
    got |= {r.node: r.root for r in components(linked).collect()}
    classes = lambda roots: sorted(sorted(k for k in roots if roots[k] == r) for r in set(roots.values()))
    assert classes(got) == classes({p: signed(want[unsigned[p]]) for p in prints})


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(60)] + [(100, n) for n in range(200, 260)] + [(7, 7), (301, 300)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {n: 0 for n in range(61)} | {n: 100 for n in [100, *range(200, 260)]} | {300: 300, 301: 300}
    assert components(frame.limit(0)).collect() == []


def test_fingerprints_of_texts():
    rng = random.Random(2)
    texts = ["", "  \n", "One", "a b c", "a b c d", "É é x Y", "A" * 5000] + [
        " ".join(rng.choices("abcdE", k=rng.randrange(1, 300))) for _ in range(60)
    ]
    for text in texts:
        assert S.fingerprint_of(text) % (1 << 64) == plain_print(text)


def test_long_texts_are_counted_in_chunks(monkeypatch):
    text = " ".join(random.Random(0).choices("abcdefgh", k=500))
    whole = S.fingerprint_of(text)
    monkeypatch.setattr(S, "CHUNK", 7)
    assert S.fingerprint_of(text) == whole


def test_query_over_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    prints = {d.doc_id: plain_print(d.text) for d in docs}
    roots = plain_roots(prints.values(), 4)
    least = {}
    for doc, p in prints.items():
        least[roots[p]] = min(doc, least.get(roots[p], doc))
    got = op8_simhash(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(docs)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16
        assert r.component_id == least[roots[prints[r.doc_id]]]


def test_odd_rows_and_one_row_of_each_component(spark):
    text = " ".join(f"w{n}" for n in range(400))
    rows = [
        (5, text, "x"), (3, text + " more", "y"), (3, text + " more", "y"), (None, text, "z"),
        (9, "other words entirely here and there", "x"), (11, None, "x"), (10, "", "x"), (None, "alone it is", "q"),
        (None, "alone it is", "q"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = Counter((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == Counter({(5, 3): 1, (3, 3): 2, (None, 3): 1, (9, 9): 1, (11, 10): 1, (10, 10): 1, (None, None): 2})
    kept = S.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (tuple(r)[0] for r in kept.collect()))) == ["10", "3", "9", "None"]
    for frame in (S.near_duplicates(docs.limit(0)), S.deduplicated(docs.limit(0))):
        assert frame.collect() == []
