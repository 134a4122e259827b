"""Source divergence audit: which sources of a language differ, and in which terms.

Terms are counted inside tasks before anything is shuffled. A group (language, source)
reports its terms of highest value `(p - q)^2 / q`, where p is the term's share in the group
and q its share in the language. The value rises with the group's count and falls with the
language's count, whatever their totals are, so a term that k others beat or equal in both,
and precede in UTF-8, is not among the first k. Partitions therefore keep the k-skyband of
their terms by counts alone, skybands of partitions are merged, and what is left is ranked
exactly.

Pairs of sources are compared over all kept terms. Where a term is missing in both sources
its part of the sum is the same for all terms, so only terms that occur are visited.

Null texts, languages and sources are ''. Each row is a document, repeated ids and texts
included. A group without terms still has its pairs; a language without kept terms has the
value 0 in all of them. Equal values are ranked by UTF-8. Other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.llm.common import small_batches, stored, whole_text

#: Documents of a language that make a term count, ranks reported of a group's terms.
LEAST_DOCUMENTS, TOP = 3, 200
#: A share of all is this many parts.
PARTS = 1_000_000_000
#: What a task holds before it hands its counts on: entries, and bytes of text behind them.
ENTRIES, TEXT_BYTES = 300_000, 64 << 20
#: Rows of an Arrow batch of counts.
BATCH = 50_000
#: Terms of a group in one partition's skyband, and skybands merged in one task.
BUCKET, FAN = 8192, 32
#: Sources of a language compared in one task, comparisons of one task, the fewest that a share counts as, cells held at a time.
TILE, COMPARISONS, LEAST_COMPARED, CELLS = 512, 2_000_000, 20, 1 << 21

#: Every byte that is no part of a term becomes a blank: ASCII but for its letters.
_BLANKS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8; only A-Z are lower-cased, as `bytes.lower` does."""
    return text.translate(_BLANKS).lower().split()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """`lang, source, term, count, documents`, in parts: a group's term may have several rows."""

    def batches_of(counts: dict, documents: dict) -> Iterator[pa.RecordBatch]:
        for (tongue, origin), found in counts.items():
            terms, seen = list(found), documents[tongue, origin]
            for at in range(0, len(terms), BATCH):
                some = terms[at : at + BATCH]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([tongue] * len(some), pa.string()),
                        pa.array([origin] * len(some), pa.string()),
                        pa.array(some, pa.binary()),
                        pa.array([found[term] for term in some], pa.int64()),
                        pa.array([seen[term] for term in some], pa.int64()),
                    ],
                    ["lang", "source", "term", "count", "documents"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = {}
        documents: dict[tuple, Counter] = {}
        entries = size = 0
        for batch in batches:
            for tongue, origin, content in zip(*(column.to_pylist() for column in batch.columns)):
                terms = terms_of(content)
                if not terms:
                    continue
                found = counts.setdefault((tongue, origin), Counter())
                entries, size = entries - len(found), size + len(content)
                found.update(terms)
                documents.setdefault((tongue, origin), Counter()).update(set(terms))
                entries += len(found)
                if entries >= ENTRIES or size >= TEXT_BYTES:
                    yield from batches_of(counts, documents)
                    counts, documents, entries, size = {}, {}, 0, 0
        yield from batches_of(counts, documents)

    read = small_batches(docs).select(
        whole_text(F.col(f"`{lang}`")).alias("lang"),
        whole_text(F.col(f"`{source}`")).alias("source"),
        whole_text(F.col(f"`{text}`")).cast("binary").alias("text"),
    )
    counted = read.mapInArrow(run, "lang string, source string, term binary, count long, documents long")
    return counted.withColumn("term", F.col("term").cast("string"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """`lang, source, term, count, lang_count, first`: the terms in `least` documents of their language.

    `first` marks one row of each term of a language. One shuffle serves the sums of groups
    and of languages.
    """
    dealt = counts.repartition("lang", "term").groupBy("lang", "term", "source")
    each = dealt.agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    term = Window.partitionBy("lang", "term")
    wide = each.select(
        "lang",
        "source",
        "term",
        "count",
        F.sum("count").over(term).alias("lang_count"),
        F.sum("documents").over(term).alias("lang_documents"),
        (F.col("source") == F.min("source").over(term)).alias("first"),
    )
    return wide.where(F.col("lang_documents") >= least).drop("lang_documents")


def group_totals(docs: DataFrame, kept: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Of every group: its kept occurrences and terms, those of its language, its number among the sources."""
    groups = docs.select(
        whole_text(F.col(f"`{lang}`")).alias("lang"), whole_text(F.col(f"`{source}`")).alias("source")
    ).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("terms"))
    all_of = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.count_if("first").alias("v"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return groups.join(own, ["lang", "source"], "left").join(all_of, "lang", "left").select(
        "lang",
        "source",
        *(F.coalesce(name, F.lit(0)).alias(name) for name in ("n", "terms", "lang_n", "v")),
        F.floor(number / TILE).cast("int").alias("tile"),
        F.count("*").over(Window.partitionBy("lang")).alias("sources"),
    )


def share(count: Column, total: Column, terms: Column) -> Column:
    """`1 + floor(PARTS * (count + 1) / (total + terms))`, exactly; no count is too large for it."""
    above = F.lit(PARTS).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", above, (total + terms).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def skyband(terms: pa.Table, k: int) -> pa.Table:
    """The rows that fewer than k others dominate: by a count as high, a `lang_count` as low, an earlier term.

    Rows are taken by falling count, so that only rows before one can dominate it. A row that
    was left out has k kept dominators, which dominate all it dominates: counting the kept
    ones is enough. They are counted by a binary indexed tree over the terms; a node needs its
    k lowest `lang_count`s only.
    """
    terms = terms.sort_by([("count", "descending"), ("lang_count", "ascending"), ("term", "ascending")])
    n = terms.num_rows
    places = np.empty(n, dtype=np.int64)
    places[pc.sort_indices(terms["term"]).to_numpy()] = np.arange(1, n + 1)
    nodes: list[list[int]] = [[] for _ in range(n + 1)]
    kept = []
    for row, (place, low) in enumerate(zip(places.tolist(), terms["lang_count"].to_pylist())):
        found, node = 0, place
        while node and found < k:
            found += bisect_right(nodes[node], low)
            node &= node - 1
        if found >= k:
            continue
        kept.append(row)
        while place <= n:
            insort(nodes[place], low)
            del nodes[place][k:]
            place += place & -place
    return terms.take(pa.array(kept, pa.int64()))


def group_skybands(terms: DataFrame, most: int, k: int = TOP, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """Rows of `lang, source, term, count, lang_count, terms, ...` in their group's k-skyband.

    A group of `terms` terms, of `most` at most, is dealt into partitions of about `bucket`
    terms; then `fan` skybands at a time become one. No task holds more than that.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("terms") / bucket)).cast("long")
    band = terms.withColumn("part", F.pmod(F.xxhash64("term"), parts))
    schema, left = band.schema, max(1, -(-most // bucket))

    def run(table: pa.Table) -> pa.Table:
        return skyband(table, k)

    while True:
        band = band.groupBy("lang", "source", "part").applyInArrow(run, schema)
        if left == 1:
            return band.drop("part")
        band, left = band.withColumn("part", F.floor(F.col("part") / fan)), -(-left // fan)


def top_terms(kept: DataFrame, totals: DataFrame, top: int = TOP, bucket: int = BUCKET, fan: int = FAN) -> DataFrame:
    """`lang, source, item, value, rank`: the first `top` terms that a group has more of than its language."""
    most = totals.agg(F.max("terms")).first()[0] or 0
    shares = kept.join(totals, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        "count",
        "lang_count",
        "terms",
        share(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        share(F.col("lang_count"), F.col("lang_n"), F.col("v")).alias("q"),
    )
    # Whatever dominates a term that passes here passes too.
    band = group_skybands(shares.where("p > q"), most, top, bucket, fan)
    valued = band.select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    return ranked(valued).where(F.col("rank") <= top)


def ranked(valued: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(order))


_PAIR = "lang string, source string, item string, more long, both_missing long, v long"


def _pair_sums(key: tuple, table: pa.Table) -> pa.Table:
    """Of each ordered pair of sources in the table: what its terms add to the value of missing terms.

    Rows without a term name the sources, with the share p of a missing term; the others hold
    the shares of terms that occur.
    """
    lang, first, second = key[0].as_py(), key[2].as_py(), key[3].as_py()
    named = table.filter(pc.is_null(table["term"]))
    found = table.filter(pc.is_valid(table["term"]))
    sources, missing = named["source"], named["p"].to_numpy()
    tiles, v = named["tile"].to_numpy(), named["v"].to_pylist()
    n = len(missing)
    column = pc.index_in(found["source"], value_set=sources.combine_chunks()).to_numpy()
    codes = found["term"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    codes, column, shares = codes[order], column[order], found["p"].to_numpy()[order]

    def values(own: np.ndarray, other: np.ndarray) -> np.ndarray:
        apart = own - other
        return apart * apart // other

    none = values(missing[:, None], missing[None, :])
    more = np.zeros((n, n), dtype=np.int64)
    height = max(1, CELLS // max(n, 1))
    for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, height):
        start, end = np.searchsorted(codes, [low, low + height])
        rows = codes[start:end] - low
        held = np.tile(missing, (int(rows[-1]) + 1, 1))
        held[rows, column[start:end]] = shares[start:end]
        for own in range(n):
            more[own] += (values(held[:, own : own + 1], held) - none[own]).sum(axis=0)
    # A pair of two tiles is told in the table of both; one of a single tile in its own.
    wanted = ~np.eye(n, dtype=bool) if first == second else tiles[:, None] != tiles[None, :]
    own, other = np.nonzero(wanted)
    return pa.table(
        {
            "lang": pa.array([lang] * len(own), pa.string()),
            "source": sources.take(pa.array(own)).cast(pa.string()),
            "item": sources.take(pa.array(other)).cast(pa.string()),
            "more": more[own, other],
            "both_missing": none[own, other],
            "v": np.array(v, dtype=np.int64)[own],
        }
    )


def source_pairs(kept: DataFrame, totals: DataFrame, comparisons: int = COMPARISONS) -> DataFrame:
    """`lang, source, item, value, rank`: each ordered pair of a language's sources, over all kept terms.

    A language's terms are dealt into as many parts as its comparisons need. More than `TILE`
    sources are compared tile by tile, so that a task's table of pairs has a bound.
    """
    compared = F.greatest(F.least(F.col("sources"), F.lit(2 * TILE)), F.lit(LEAST_COMPARED))
    per_term = F.col("sources").cast("double") * compared
    parts = F.greatest(F.lit(1), F.ceil(F.col("v") * per_term / comparisons)).cast("long")
    known = totals.withColumn("parts", parts).withColumn("tiles", F.ceil(F.col("sources") / TILE).cast("int"))
    absent = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1)).cast("long")

    def dealt(rows: DataFrame, part: Column, term: Column, p: Column) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
        spread = rows.select("lang", "source", "tile", "v", term.alias("term"), p.alias("p"), part.alias("part"), other)
        low, high = F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")
        return spread.select("lang", "source", "tile", "v", "term", "p", "part", low, high)

    named = known.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sources = dealt(named, F.col("part"), F.lit(None).cast("string"), absent)
    shares = share(F.col("count"), F.col("n"), F.col("v")).cast("long")
    occurring = kept.drop("first").join(known, ["lang", "source"])
    terms = dealt(occurring, F.pmod(F.xxhash64("term"), F.col("parts")), F.col("term"), shares)
    sums = sources.union(terms).groupBy("lang", "part", "low", "high").applyInArrow(_pair_sums, _PAIR)
    whole = sums.groupBy("lang", "source", "item").agg(
        (F.sum("more") + F.max("v") * F.max("both_missing")).alias("value")
    )
    return ranked(whole)


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    least: int = LEAST_DOCUMENTS,
    top: int = TOP,
    bucket: int = BUCKET,
    fan: int = FAN,
) -> DataFrame:
    """`lang, source, part, item, value, rank`: part `pair` has each other source, `term` the first terms."""
    kept = stored(kept_terms(term_counts(docs, text, lang, source), least), "divergence-terms")
    totals = stored(group_totals(docs, kept, lang, source), "divergence-totals")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(kept, totals).withColumn("part", F.lit("pair"))
    terms = top_terms(kept, totals, top, bucket, fan).withColumn("part", F.lit("term"))
    return pairs.select(columns).union(terms.select(columns))
