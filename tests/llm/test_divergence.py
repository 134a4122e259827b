"""The divergence audit against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from hydroframe.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=3, top=200):
    """The audit of (text, lang, source) rows, by its definition."""
    counts, documents = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        found = TERM.findall(text.translate(LOWER))
        counts[lang, source].update(found)
        documents[lang].update(set(found))
    out = []
    for lang, source in counts:
        kept = [t for t, n in documents[lang].items() if n >= least]
        v, mine = len(kept), {s: c for (tongue, s), c in counts.items() if tongue == lang}
        whole = sum(mine.values(), Counter())

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + v) for t in kept}

        p, q = shares(mine[source]), shares(whole)
        pairs = []
        for s in mine:
            if s != source:
                r = shares(mine[s])
                pairs.append((-sum((p[t] - r[t]) ** 2 // r[t] for t in kept), s.encode(), s))
        terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if mine[source][t] and p[t] > q[t]]
        out += [(lang, source, "pair", s, -f, i) for i, (f, _, s) in enumerate(sorted(pairs), 1)]
        out += [(lang, source, "term", t, -f, i) for i, (f, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def audited(spark, rows, **how):
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    return sorted(map(tuple, divergence.audit(docs, **how).collect()))


def corpus(seed, documents, words, sources, tongues=("de", "en")):
    draw = random.Random(seed)
    vocabulary = [f"{draw.choice('abcÄéß漢')}{'xyz'[i % 3]}{chr(97 + i % 26)}{chr(0x100 + i)}" for i in range(words)]
    rows = []
    for _ in range(documents):
        source = draw.randrange(sources)
        some = [vocabulary[int(draw.random() ** (1 + source % 3) * words)].upper() for _ in range(draw.randrange(60))]
        rows.append((" ".join(some), draw.choice(tongues), f"s{source}"))
    return rows


@pytest.mark.parametrize("bucket, fan, top", [(7, 2, 5), (50, 3, 20), (8192, 32, 200)])
def test_audit_equals_plain_counting(spark, bucket, fan, top):
    rows = corpus(1, 120, 300, 5)
    assert audited(spark, rows, bucket=bucket, fan=fan, top=top) == plain(rows, top=top)


def test_sources_beyond_a_tile_and_terms_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)
    rows = corpus(2, 200, 80, 10, ("en",))
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    kept = divergence.kept_terms(divergence.term_counts(docs)).cache()
    totals = divergence.group_totals(docs, kept).cache()
    pairs = divergence.source_pairs(kept, totals, comparisons=300)
    got = sorted((r.lang, r.source, "pair", r["item"], r.value, r.rank) for r in pairs.collect())
    assert got == [row for row in plain(rows) if row[2] == "pair"]


def test_odd_rows(spark):
    rows = [
        (None, None, None), ("", "en", "a"), ("12 34 [] \x7f", "en", "b"), ("İ I ı i", "tr", "a"),
        ("I i", "tr", "b"), ("i Iİ", "tr", "b"), ("I", "tr", None), ("one", None, "x"), ("one", "", "x"),
        ("ONE", "", "x"), ("one\x00one", "", None), ("only once", "xx", "lonely"),
    ]
    rows += [("Hot passage of many copies " * 300, "en", "hot")] * 40
    assert audited(spark, rows) == plain(rows)


def test_other_columns_and_empty_table(spark):
    rows = corpus(3, 30, 40, 3)
    names = ["term", "count", "part", "value", "rank", "v", "n"]
    wide = spark.createDataFrame(
        [(*row, *range(len(names))) for row in rows],
        "body string, tongue string, origin string, " + ", ".join(f"{n} int" for n in names),
    )
    got = divergence.audit(wide, text="body", lang="tongue", source="origin")
    assert sorted(map(tuple, got.collect())) == plain(rows)
    assert divergence.audit(wide.limit(0), text="body", lang="tongue", source="origin").collect() == []


def test_counts_beyond_a_long_times_the_parts(spark):
    large = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 7)], "c long, n long, v long")
    got = large.select(divergence.share(large.c, large.n, large.v).alias("p")).first().p
    assert got == 1 + 10**9 * (9 * 10**18 + 1) // (9_100_000_000_000_000_000 + 7)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_skyband_equals_counting_dominators(k):
    draw = random.Random(k)
    rows = [(draw.randrange(1, 8), draw.randrange(8, 30), f"t{i:03}".encode()) for i in range(300)]
    draw.shuffle(rows)
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(("count", "lang_count", "term"))})
    got = {tuple(r.values()) for r in divergence.skyband(table, k).to_pylist()}
    want = {
        a for a in rows
        if sum(b != a and b[0] >= a[0] and b[1] <= a[1] and b[2] < a[2] for b in rows) < k
    }
    assert got == want
