"""SimHash near duplicates by deletion-variant signatures.

Fingerprints of 64 bits that differ in at most d bits are cut into floor(d / 2) + 1
segments, so that in one segment they differ by one bit at most. Each segment is indexed
once for each of its bits with that bit left out; two segments that differ in one bit, or
none, share such a variant. Fingerprints that share a variant are compared bit by bit.

Copies and texts of equal fingerprint are one fingerprint. A variant shared by very many
fingerprints is indexed again by variants of its other bits. What then still shares a key
is dense: such a group is cut into blocks, and each task compares two of them, so that no
task holds a group without bound. Every task passes on only links that join what its other
links have not joined already: links grow with the fingerprints, not with the square of a
group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import small_batches, stored, whole_text
from hydroframe.llm.components import components

BITS, SEED = 64, 42
#: Fingerprints of one variant that are compared in one task; more are indexed again, then cut
#: into blocks of about as many.
GROUP = 4000
#: Fingerprints a task indexes.
INDEXED = 100_000
#: Rows of variants worked on together, and more until a group ends.
TOGETHER = 1 << 15
#: Groups up to this size are compared many at a time.
SMALL = 16
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint_of(text: str, shingle: int = 4) -> int:
    """The text's fingerprint as a signed 64-bit integer."""
    words = text.encode().lower().split()  # bytes: only A-Z are lower-cased
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    set_bits = np.zeros(BITS, dtype=np.int64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends.tolist()]
    last = starts[min(shingle, len(words)) :]
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)], last[at:])
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_column: str = "text", shingle: int = 4) -> DataFrame:
    """The other columns and `fingerprint` (long). Null and empty texts, and texts without
    a word, have fingerprint zero; a text of fewer words than a shingle is one shingle."""
    others = [c for c in docs.columns if c != text_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint_of(text, shingle) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(made, pa.int64())], [*others, "fingerprint"]
            )

    read = small_batches(docs).select(whole_text(F.col(text_column)).alias("text"), *others)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[1:]]
    return read.mapInArrow(run, ", ".join([*fields, "fingerprint long"]))


def _cut(positions: list[int], distance: int) -> list[list[int]]:
    """The bit positions in floor(distance / 2) + 1 segments of nearly equal length."""
    n = distance // 2 + 1
    return [positions[len(positions) * i // n : len(positions) * (i + 1) // n] for i in range(n)]


def _mask(positions: list[int]) -> int:
    mask = sum(1 << p for p in positions)
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _variants(distance: int) -> list[tuple[int, list[int]]]:
    """(mask of what a variant keeps, the bit positions outside its segment)."""
    every = list(range(BITS))
    return [
        (_mask([p for p in segment if p != left_out]), [p for p in every if p not in segment])
        for segment in _cut(every, distance)
        for left_out in segment
    ]


def _indexed(prints: DataFrame, distance: int) -> DataFrame:
    """`key`, `f` for each fingerprint and variant. Keys are hashes: equal variants have
    equal keys, and fingerprints brought together by chance fail the comparison."""
    f = F.col("f")
    keys = [F.xxhash64(F.lit(n), f.bitwiseAND(F.lit(m))) for n, (m, _) in enumerate(_variants(distance))]
    numbered = [F.struct(k.alias("key"), F.lit(n).alias("variant")) for n, k in enumerate(keys)]
    # Fingerprints are few bytes, their variants many: the tasks are set by what comes out.
    tasks = max(prints.sparkSession.sparkContext.defaultParallelism, prints.count() // INDEXED)
    prints = prints.select("f").repartition(tasks, "f")
    return prints.select("f", F.explode(F.array(*numbered)).alias("v")).select("v.key", "v.variant", "f")


def _indexed_again(hot: DataFrame, distance: int) -> DataFrame:
    """Rows of hot variants under variants of the bits outside their segment."""
    f, made = F.col("f"), F
    for n, (_, outside) in enumerate(_variants(distance)):
        keys = [
            F.xxhash64(F.col("key"), F.lit(part), F.lit(left_out), f.bitwiseAND(F.lit(_mask([p for p in segment if p != left_out]))))
            for part, segment in enumerate(_cut(outside, distance))
            for left_out in segment
        ]
        made = made.when(F.col("variant") == n, F.array(*keys))
    return hot.select(F.explode(made).alias("key"), "f")


def _in_blocks(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """`rows` of the keys in `sizes` (key, n) under a key for each two blocks of their group.

    A row goes to the pairs of its own block with every other one, so that any two rows of
    a group meet, also those of one block. Equal fingerprints are in one block.
    """
    blocks = F.ceil(F.col("n") / GROUP)
    own = F.pmod(F.xxhash64("f", F.lit(SEED)), F.col("blocks"))
    dealt = rows.join(sizes.select("key", blocks.alias("blocks")), "key").select("key", "f", "blocks", own.alias("own"))
    met = dealt.select("key", "f", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return met.where("own != other").select(pair.alias("key"), "f")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; counted unsigned, as `bitwise_count` takes a signed number's absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _near(fs: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Pairs of one group that differ in at most `distance` bits, in blocks."""
    step = max(1, (1 << 20) // max(1, len(fs)))
    for at in range(0, len(fs), step):
        block = fs[at : at + step]
        near = differing(block[:, None], fs[None, :]) <= distance
        left, right = np.nonzero(near)
        ahead = right > left + at
        yield from zip(block[left[ahead]].tolist(), fs[right[ahead]].tolist())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole groups of the rows, which come sorted by key: (keys, fingerprints)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n < TOGETHER:
            continue
        keys, fs = (np.concatenate(side) for side in zip(*held))
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield keys[:cut], fs[:cut]
        held, n = [(keys[cut:], fs[cut:])], len(keys) - cut
    if held:
        keys, fs = (np.concatenate(side) for side in zip(*held))
        yield keys, fs


class Joined:
    """What links of this task have joined already."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, node: int) -> int:
        up = self.up
        while (above := up.get(node, node)) != node:
            up[node] = up.get(above, above)
            node = above
        return node

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(indexed: DataFrame, distance: int) -> DataFrame:
    """`a`, `b`: links that connect what is connected in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = Joined()
        for keys, fs in _groups(batches):
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            found: list[tuple[int, int]] = []
            small = np.repeat(sizes, sizes) <= SMALL
            for ahead in range(1, SMALL):  # all small groups together, by distance between rows
                same = (keys[ahead:] == keys[:-ahead]) & small[ahead:]
                if not same.any():
                    break
                a, b = fs[:-ahead][same], fs[ahead:][same]
                near = differing(a, b) <= distance
                found += (p for p in zip(a[near].tolist(), b[near].tolist()) if joined.joins(*p))
            for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
                found += (p for p in _near(fs[start : start + size], distance) if joined.joins(*p))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(side, pa.int64()) for side in zip(*found)], ["a", "b"]
                )

    dealt = indexed.select("key", "f").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def _crowded(indexed: DataFrame, name: str) -> DataFrame:
    """`key`, `n` of the keys of more than GROUP rows."""
    counts = indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return stored(counts.where(F.col("n") > GROUP), name)


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """`a`, `b`: links between the distinct fingerprints `f` that connect what is connected."""
    indexed = _indexed(prints, distance)
    hot = _crowded(indexed, "hot")
    if hot.isEmpty():
        return _links(indexed, distance)
    found = _links(indexed.join(hot, "key", "left_anti"), distance)
    again = _indexed_again(indexed.join(hot, "key", "left_semi"), distance)
    dense = _crowded(again, "dense")
    if dense.isEmpty():
        return found.union(_links(again, distance))
    found = found.union(_links(again.join(dense, "key", "left_anti"), distance))
    return found.union(_links(_in_blocks(again, dense), distance))


def _classes(made: DataFrame, least: Column, distance: int) -> tuple[DataFrame, DataFrame]:
    """`made` stored, and for each fingerprint the least of its component's rows."""
    made = stored(made, "fingerprints")
    own = stored(made.groupBy(F.col("fingerprint").alias("f")).agg(F.min(least).alias("first")), "prints")
    roots = components(links(own.select("f"), distance)).withColumnRenamed("node", "f")
    rooted = own.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f"))
    first = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return made, rooted.select("f", "root").join(first, "root").select("f", "component")


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """The id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable
    over fingerprints that differ in at most `distance` bits.

    Texts without words have fingerprint zero, linked like any other. Rows of null id are
    linked too; a component of null ids only has a null component_id. Repeated rows have
    equal components. An empty table gives no rows; other columns are ignored.
    """
    read = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    made, classes = _classes(fingerprints(read, "text", shingle), F.col("id"), distance)
    return made.join(classes, made["fingerprint"] == classes["f"]).select(
        F.col("id").alias(id_column),
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def deduplicated(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """The rows of `docs` with one of each component: that of the smallest id (null ids last).

    Of rows equal in every column one stays. Columns are those of the input.
    """
    columns = docs.columns
    whole = F.xxhash64(*(F.col(f"`{c}`") for c in columns))
    keyed = docs.select(
        F.struct("*").alias("row"), F.struct(F.col(id_column).isNull(), F.col(id_column), whole).alias("k")
    )
    read = keyed.select("k", F.col(f"row.{text_column}").alias("text"))
    made, classes = _classes(fingerprints(read, "text", shingle), F.col("k"), distance)
    kept = classes.select(F.xxhash64("component").alias("mark"), F.col("component").alias("k")).distinct()
    times = made.groupBy("k").count().where("count > 1").select(F.xxhash64("k").alias("mark"), "k")
    marked = keyed.select("row", "k", F.xxhash64("k").alias("mark"))
    stays = stored(
        kept.join(times.select("mark", F.lit(True).alias("many")), "mark", "left").select("mark", "many"), "kept"
    )
    found = marked.join(stays, "mark")
    once = found.where("many is null").select("row.*")
    if stays.where("many").isEmpty():
        return once
    return once.union(found.where("many").dropDuplicates(["mark"]).select("row.*"))
