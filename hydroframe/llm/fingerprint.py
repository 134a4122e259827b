"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch keeps the k smallest distinct 64-bit hashes of a text's shingles of five words,
as hexadecimal text in ascending order. The k smallest of two sketches' union are the
sketch of both parts together, so sketches merge without their texts, and from them come
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.llm.common import small_batches, whole_text

#: Hashes in a sketch, words in a shingle.
K, SHINGLE = 128, 5
#: Word hashes a task remembers, and the longest such word in bytes.
REMEMBERED, LONGEST = 400_000, 64
#: Text bytes in a bucket of `edited`, and the most buckets (their bounds are the driver's).
BUCKET, MOST_BUCKETS = 8 << 20, 65_536

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class WordHashes(dict):
    """Hash of each word, worked out once; long words are not remembered."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


def shingle_hashes(words: list[bytes], known: WordHashes, length: int = SHINGLE) -> np.ndarray:
    """Hash of each shingle, repeats included. Fewer words than a shingle make one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
    width = min(length, n)
    mixed = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        mixed += hashes[i : n - width + 1 + i]
        mixed *= _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    for by, shift in ((_MIX[1], 30), (_MIX[2], 27)):
        mixed ^= mixed >> np.uint64(shift)
        mixed *= by
    mixed ^= mixed >> np.uint64(31)
    return mixed


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    if len(hashes) > 8 * k:
        low = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def sketch_text(text: str, known: WordHashes, k: int = K) -> str:
    return bottom(shingle_hashes(text.encode().split(), known), k).astype(">u8").tobytes().hex()


def sketch(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """The id and `sketch` of each whole text. Null and empty texts have an empty sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            made = [sketch_text(text, known, k) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [id_column, "sketch"])

    read = small_batches(docs).select(F.col(id_column), whole_text(F.col(text_column)))
    kind = read.schema[0].dataType.simpleString()
    return read.mapInArrow(run, f"`{id_column}` {kind}, sketch string")


def hashes_of(sketch: Column) -> Column:
    """The sketch's hashes; fixed-width hexadecimal sorts as the numbers do."""
    return F.regexp_extract_all(sketch, F.lit("[0-9a-f]{16}"), 0)


def union(left: Column, right: Column, k: int = K) -> Column:
    return F.slice(F.array_sort(F.array_union(left, right)), 1, k)


def resemblance(left: Column, right: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two arrays of hashes: 1 for two empty ones, 0 for one.

    Exact where both texts have together at most k distinct shingles.
    """
    both = union(left, right, k)
    shared = F.size(F.array_intersect(F.array_intersect(left, right), both))
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / F.size(both))


def distinct_shingles(hashes: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.conv(F.substring(F.element_at(hashes, k), 1, 8), 16, 10).cast("double") + 0.5
    return F.when(F.size(hashes) < k, F.size(hashes).cast("double")).otherwise((k - 1) * 2.0**32 / top)


def containment(left: Column, right: Column, k: int = K) -> Column:
    """Estimated share of the left text's shingles that the right one has; 1 for an empty left."""
    whole = distinct_shingles(union(left, right, k), k)
    share = resemblance(left, right, k) * whole / distinct_shingles(left, k)
    return F.when(F.size(left) == 0, 1.0).otherwise(F.least(share, F.lit(1.0)))


def merged(parts: DataFrame, keys: list[str], sketch_column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key: that of all its parts together.

    Each task keeps the k smallest of a key before the shuffle (the window's group limit),
    so that a key with very many parts sends k hashes from each task.
    """
    hashes = parts.select(*keys, F.explode_outer(hashes_of(F.col(sketch_column))).alias("__hash"))
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("__hash"))
    least = hashes.withColumn("__n", F.dense_rank().over(order)).where(F.col("__n") <= k).distinct()
    return least.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__hash")), "").alias("sketch"))


def edited(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = K) -> DataFrame:
    """Sketches of each text and of its edited text: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, next_fingerprint.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's in descending id, the first document's after the
    last; one document alone follows itself. Null ids come last; equal ids are ordered by text.
    A null text is empty; an empty table gives no rows; other columns are ignored.

    Documents are dealt into ranges of ids by approximate quantiles, each text shuffled
    once; the first document of a range goes to the range before it as well, so that each
    task has every neighbour it needs. A task streams its sorted rows, holding two texts.
    """
    text = whole_text(F.col(text_column)).alias("text")
    read = small_batches(docs).select(F.col(id_column).cast("long").alias("id"), text)
    n_bytes = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = int(min(max(128, n_bytes // BUCKET), MOST_BUCKETS))
    shares = [n / wanted for n in range(1, wanted)]
    cut = read.agg(F.percentile_approx("id", shares, max(10_000, 4 * wanted))).first()[0]
    bounds = np.unique(np.array(cut or [], dtype=np.int64))
    last = len(bounds) + 1  # bucket 0 has the largest ids, bucket `last` the null ones

    def buckets(ids: pa.Array) -> np.ndarray:
        known = ids.fill_null(0).to_numpy(zero_copy_only=False)
        found = len(bounds) - np.searchsorted(bounds, known, side="right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), last, found)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(buckets(batch.column(0)), pa.int32())
            yield pa.RecordBatch.from_arrays([made, batch.column(0)], ["bucket", "id"])

    # The first id of each bucket that has rows: as many rows as there are buckets.
    firsts = read.select("id").mapInArrow(counted, "bucket int, id long").groupBy("bucket").agg(F.max("id"))
    heads = sorted((bucket, head) for bucket, head in firsts.collect())
    goes = {head: heads[at - 1][0] for at, (_, head) in enumerate(heads)}  # also to this bucket

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "extra", "id", "text"]
        for batch in batches:
            ids, texts = batch.columns
            own = pa.array(buckets(ids), pa.int32())
            none = pa.array(np.zeros(len(ids), dtype=bool))
            yield pa.RecordBatch.from_arrays([own, none, ids, texts], names)
            at = [n for n, i in enumerate(ids.to_pylist()) if i in goes]
            if at:
                some = pa.array(at)
                to = pa.array([goes[i] for i in ids.take(some).to_pylist()], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [to, pa.array([True] * len(at)), ids.take(some), texts.take(some)], names
                )

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(id, text, next text) of each row that is no extra."""
        held = None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if held is not None and held[0] == row[0] and not held[1]:
                    yield held[2], held[3], row[3]
                held = row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out, before = WordHashes(), [], (None, "")
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for key, text, following in paired(batches):
            half = len(text) // 2
            changed = text[: len(text) - half] + following[:half]
            after = sketch_text(following, known, k)
            own = before[1] if before[0] == text else sketch_text(text, known, k)
            before = (following, after)
            digest = hashlib.sha256(changed.encode()).hexdigest()
            out.append((key, len(text), digest, own, sketch_text(changed, known, k), after))
            if len(out) == 500:
                yield batch()
                out.clear()
        if out:
            yield batch()

    rows = (
        read.mapInArrow(dealt, "bucket int, extra boolean, id long, text string")
        .repartition(wanted, "bucket")  # as many tasks as the texts' bytes ask for
        .sortWithinPartitions("bucket", "extra", F.desc_nulls_last("id"), "text")
    )
    return rows.mapInArrow(
        run,
        "id long, n_chars long, edited_sha256 string, fingerprint string,"
        " edited_fingerprint string, next_fingerprint string",
    ).withColumnRenamed("id", id_column)
