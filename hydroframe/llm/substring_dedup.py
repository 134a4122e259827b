"""Substring dedup: words covered by a window that occurs elsewhere are removed.

Suffix automata of reference shards give matching statistics: for each word of a passage,
the longest sequence ending there that the shard has twice or more. Spans of at least a
window's length are removed.

The reference is the corpus itself, so its shards are not broadcast whole: a shard is what
may match. In each window of `window` words the least hash of its runs of ANCHOR words is
its anchor; equal windows have equal anchors. Anchors that occur once cannot match and are
dropped; a passage is the windows of one occurrence of an anchor, and the passages of one
anchor are one shard, brought to one task, indexed and streamed. A shard of very many
passages is not indexed: its windows are counted by their digests instead, with partial
counts before the shuffle. Nothing depends on the order of documents, and no
two documents are compared that share no anchor.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hydroframe.llm.common import WORD, aside, carried, small_batches, stored, whole_text
from hydroframe.llm.fingerprint import WordHashes

WINDOW, ANCHOR = 35, 16
#: Rows a task turns into Python objects at a time.
ROWS = 500
#: Occurrences of an anchor whose passages are indexed together.
GROUP = 2000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Automaton:
    """Suffix automaton of several sequences with the number of places of each state."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.places = [-1], [0], [0]
        self.twice: list[int] = []

    def _state(self, following: dict, link: int, length: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.places.append(0)
        return len(self.link) - 1

    def _cloned(self, at: int, symbol, old: int) -> int:
        """A state for the part of `old` that ends behind `at` too."""
        new = self._state(dict(self.next[old]), self.link[old], self.length[at] + 1)
        self.link[old] = new
        while at >= 0 and self.next[at].get(symbol) == old:
            self.next[at][symbol] = new
            at = self.link[at]
        return new

    def add(self, sequence: Iterable, times: int = 1) -> None:
        last = 0
        for symbol in sequence:
            known = self.next[last].get(symbol)
            if known is not None:
                if self.length[known] != self.length[last] + 1:
                    known = self._cloned(last, symbol, known)
                last = known
            else:
                new, at = self._state({}, 0, self.length[last] + 1), last
                while at >= 0 and symbol not in self.next[at]:
                    self.next[at][symbol] = new
                    at = self.link[at]
                if at >= 0:
                    old = self.next[at][symbol]
                    if self.length[old] != self.length[at] + 1:
                        old = self._cloned(at, symbol, old)
                    self.link[new] = old
                last = new
            self.places[last] += times

    def finish(self) -> None:
        """Sum the places, and find each state's longest ending that has two or more."""
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        for state in order:
            self.places[self.link[state]] += self.places[state]
        self.twice = [0] * len(self.link)
        for state in reversed(order):
            self.twice[state] = state if self.places[state] > 1 else self.twice[self.link[state]]

    def repeated(self, sequence: Iterable) -> Iterator[int]:
        """For each symbol, the length of the longest run ending there that occurs twice or more."""
        at = matched = 0
        for symbol in sequence:
            while at and symbol not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if symbol in self.next[at]:
                at = self.next[at][symbol]
                matched += 1
            found = self.twice[at]
            yield matched if found == at else self.length[found]


def covered(lengths: Iterable[int], window: int) -> list[tuple[int, int]]:
    """Maximal spans of the runs that are at least a window long; neighbours are merged."""
    spans: list[tuple[int, int]] = []
    for end, length in enumerate(lengths, 1):
        if length >= window:
            start = end - length
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, end))
    return spans


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of `length` word hashes, each from the sums of powers before it."""
    n = len(words)
    power = np.full(n, _BASE)
    power[:1] = 1
    power = np.cumprod(power, dtype=np.uint64)
    inverse = np.full(n, _INVERSE)
    inverse[:1] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(words * power, dtype=np.uint64)])
    found = (sums[length:] - sums[:-length]) * inverse[: n - length + 1]
    found ^= found >> np.uint64(32)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ (found >> np.uint64(29))


def anchors(words: list[bytes], known: WordHashes, window: int) -> tuple[np.ndarray, ...]:
    """Hash of each anchor, and the first and the last window that has it."""
    run = min(ANCHOR, window)
    hashes = run_hashes(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), run)
    width = window - run + 1
    least = sliding_window_view(hashes, width).argmin(axis=1) + np.arange(len(hashes) - width + 1)
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.concatenate([first[1:], [len(least)]]) - 1
    return hashes[least[first]].view(np.int64), first.astype(np.int32), last.astype(np.int32)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _batch(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


def _anchored(keyed: DataFrame, window: int) -> DataFrame:
    """`th`, `anchor`, `first`, `last` for each anchor of each text; a task takes equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = WordHashes(), set()
        names = ["th", "anchor", "first", "last"]
        for batch in _slices(batches):
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().split()
                if len(words) < window or th in seen:
                    continue
                seen.add(th)
                found = anchors(words, known, window)
                ids = pa.repeat(pa.scalar(th, pa.binary()), len(found[0]))
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, found)], names)

    return keyed.mapInArrow(run, "th binary, anchor long, first int, last int")


def _packed(keyed: DataFrame) -> DataFrame:
    """The rows with `packed`, the compressed text, in place of `text`; null stays null."""
    others = [c for c in keyed.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in _slices(batches):
            made = [None if t is None else compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), pa.array(made, pa.binary())], [*others, "packed"]
            )

    schema = T.StructType([keyed.schema[c] for c in others]).add("packed", "binary")
    return keyed.mapInArrow(run, schema)


def _passages(found: DataFrame, window: int) -> DataFrame:
    """Of texts and their hits, a passage for each: `key` (null for hot anchors), `th`, `start`, `words`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, seen = {"key": pa.int64(), "th": pa.binary(), "start": pa.int32(), "words": pa.binary()}, set()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in _slices(batches):
            out: list[tuple] = []
            for th, packed, hits in zip(*(batch.column(n).to_pylist() for n in ("th", "packed", "hits"))):
                if th in seen:
                    continue
                seen.add(th)
                words = unpack(packed).split() if packed is not None else []
                for hit in {(h["anchor"], h["first"], h["last"], h["hot"]) for h in hits}:
                    anchor, first, last, hot = hit
                    out.append((None if hot else anchor, th, first, b" ".join(words[first : last + window])))
                if len(out) > 4000:
                    yield _batch({n: (v, t) for v, (n, t) in zip(zip(*out), columns.items())})
                    out = []
            if out:
                yield _batch({n: (v, t) for v, (n, t) in zip(zip(*out), columns.items())})

    return found.mapInArrow(run, "key long, th binary, start int, words binary")


def shard_spans(passages: list[tuple[bytes, int, bytes]], window: int) -> Iterator[tuple[bytes, int, int]]:
    """Of one shard's passages (text, start, words), the spans that the shard has elsewhere."""
    places: dict[bytes, list[tuple[bytes, int]]] = {}
    for th, start, words in passages:
        places.setdefault(words, []).append((th, start))
    if len(places) == 1:
        (words, where), n = next(iter(places.items())), len(passages[0][2].split())
        spans = {words: [(0, n)] if len(where) > 1 else []}
    else:
        automaton, split = Automaton(), {words: words.split() for words in places}
        for words, where in places.items():
            automaton.add(split[words], len(where))
        automaton.finish()
        spans = {words: covered(automaton.repeated(split[words]), window) for words in places}
    for words, where in places.items():
        for th, start in where:
            for a, b in spans[words]:
                yield th, start + a, start + b


def _spans(passages: DataFrame, window: int) -> DataFrame:
    """`th`, `spans` (start, stop): repeated spans, shard by shard."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        key, held = None, []
        for batch in _slices(batches):
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key and held:
                    yield held
                    held = []
                key = k
                held.append(row)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds = {"th": pa.binary(), "start": pa.int32(), "stop": pa.int32()}
        for shard in shards(batches):
            out += shard_spans(shard, window)
            if len(out) > 8000:
                yield _batch({n: (v, t) for v, (n, t) in zip(zip(*out), kinds.items())})
                out = []
        if out:
            yield _batch({n: (v, t) for v, (n, t) in zip(zip(*out), kinds.items())})

    dealt = passages.where("key is not null").repartition("key").sortWithinPartitions("key")
    found = dealt.select("key", "th", "start", "words").mapInArrow(run, "th binary, start int, stop int")
    return found.select("th", F.array(F.struct("start", "stop")).alias("spans"))


def _windows(passages: DataFrame, window: int) -> DataFrame:
    """`passage`, `n`, `at`, `digest` of every window of `words`, which starts `at` in its passage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"passage": pa.binary(), "n": pa.int64(), "at": pa.int32(), "digest": pa.binary()}
        for batch in _slices(batches):
            out = []
            for passage, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.split()
                for at in range(len(words) - window + 1):
                    digest = hashlib.md5(b" ".join(words[at : at + window])).digest()
                    out.append((passage, n, at, digest))
            if out:
                yield _batch({name: (v, t) for v, (name, t) in zip(zip(*out), kinds.items())})

    read = passages.select("passage", "n", "words")
    return read.mapInArrow(run, "passage binary, n long, at int, digest binary")


def _hot_spans(passages: DataFrame, window: int) -> DataFrame:
    """`th`, `spans` for passages of hot anchors, told apart by MD5 digests.

    Equal passages are one, with its number of places; two places make all of it repeated.
    Of passages that occur once, the windows are looked up among those of all different
    passages. Counts are partial before the shuffle, and a passage shared by very many
    texts gives one row for each of them.
    """
    hot = passages.where("key is null").withColumn("passage", F.unhex(F.md5("words")))
    kinds = stored(
        hot.groupBy("passage").agg(F.count(F.lit(1)).alias("n"), F.first("words").alias("words")), "kinds"
    )
    windows = stored(_windows(kinds, window), "windows")
    twice = windows.groupBy("digest").agg(F.sum("n").alias("times")).where("times > 1").select("digest")
    alone = windows.where("n = 1").join(twice, "digest").select("passage", "at", (F.col("at") + window).alias("to"))
    whole = kinds.where("n > 1").select(
        "passage", F.lit(0).alias("at"), F.size(F.split(F.col("words").cast("string"), " ")).alias("to")
    )
    runs = alone.union(whole).groupBy("passage").agg(F.collect_list(F.struct("at", "to")).alias("runs"))
    found = hot.select("passage", "th", "start").join(stored(runs, "runs"), "passage")
    moved = lambda r: F.struct((F.col("start") + r["at"]).alias("start"), (F.col("start") + r["to"]).alias("stop"))
    return found.select("th", F.transform("runs", moved).alias("spans"))


#: Words and what lies before each.
_SPACED = re.compile(rb"[\x20\x09-\x0D]*" + WORD.encode())


def cut(data: bytes, removed: np.ndarray) -> str:
    """The text without its removed words; a kept word keeps the space before it."""
    parts = _SPACED.findall(data)
    tail = data[sum(map(len, parts)) :]
    kept = [part for part, gone in zip(parts, removed) if not gone]
    if kept and removed[0]:
        kept[0] = kept[0].lstrip(b" \t\n\r\x0b\f")
    return b"".join(kept + [tail] * (not removed[-1])).decode()


def _cleaned(found: DataFrame, kept: list[str], window: int, with_text: bool) -> DataFrame:
    """The columns `kept`, `text` without what is removed (null if not wanted), `n_words`,
    `n_removed`, `kept_sha256`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = {"text": pa.string(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in _slices(batches):
            out = []
            for packed, copied, spans in zip(*(batch.column(n).to_pylist() for n in ("packed", "copied", "spans"))):
                data = unpack(packed) if packed is not None else b""
                words = data.split()
                removed = np.zeros(len(words), dtype=bool)
                if copied and len(words) >= window:
                    removed[:] = True
                for span in spans or ():
                    removed[span["start"] : span["stop"]] = True
                gone = int(removed.sum())
                left = [w for w, x in zip(words, removed.tolist()) if not x] if gone else words
                digest = hashlib.sha256(b" ".join(left)).hexdigest()
                text = None
                if with_text and packed is not None:
                    text = cut(data, removed) if gone else data.decode()
                out.append((text, len(words), gone, digest))
            if out:
                columns = [pa.array(v, t) for v, t in zip(zip(*out), made.values())]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(name) for name in kept), *columns], [*kept, *made]
                )

    fields = [found.schema[name] for name in kept]
    schema = T.StructType(fields).add("text", "string").add("n_words", "long").add("n_removed", "long")
    return found.select(*kept, "packed", "copied", "spans").mapInArrow(run, schema.add("kept_sha256", "string"))


def cleaned(
    docs: DataFrame, text_column: str = "text", window: int = WINDOW, with_text: bool = True
) -> DataFrame:
    """The other columns of `docs`, carried under names of our own (`common.carried`), and
    `text` without its repeated words, `n_words`, `n_removed`, `kept_sha256`.

    Rows meet what is found in their texts by the texts' MD5 digests `th`, once to cut the
    passages to compare and once to remove what is repeated. Texts travel compressed.
    """
    text = F.col(text_column)
    columns = [c for c, name in zip(aside(docs), docs.columns) if name != text_column]
    kept = [c for c, name in zip(carried(docs), docs.columns) if name != text_column]
    keyed = small_batches(docs).select(F.unhex(F.md5(whole_text(text))).alias("th"), text.alias("text"), *columns)
    found = stored(_anchored(keyed.select("th", whole_text(F.col("text"))), window), "anchors")
    counts = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    hits = found.join(counts, "anchor").groupBy("th").agg(
        # A set: copies of a text bring the same anchors from every task.
        F.collect_set(F.struct("anchor", "first", "last", (F.col("n") > GROUP).alias("hot"))).alias("hits")
    )
    hits = stored(hits, "hits")
    copies = keyed.groupBy("th").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = stored(copies.select("th", F.lit(True).alias("copied")), "copies")
    keyed = _packed(keyed)
    passages = _passages(keyed.join(hits.hint("merge"), "th"), window)
    if hits.where("exists(hits, h -> h.hot)").isEmpty():
        spans = _spans(passages, window)
    else:
        passages = stored(passages, "passages")
        spans = _spans(passages, window).union(_hot_spans(passages, window))
    merged = spans.groupBy("th").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    marks = merged.join(copies, "th", "full")
    return _cleaned(keyed.join(marks.hint("merge"), "th", "left"), kept, window, with_text)


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW
) -> DataFrame:
    """The id, n_words, n_removed and kept_sha256 (of the kept words, joined by one space).

    A word is removed if a window of `window` words that covers it has the same words as a
    window that starts anywhere else, in the same document or another. Null and empty texts
    and texts shorter than a window keep all they have. Copies of a text of a window or more
    lose all words. Repeated rows count as copies. An empty table gives no rows, other
    columns are ignored. Nothing is approximate: hashes choose what is compared, words decide
    (windows of a shard of more than GROUP passages are told apart by their MD5 digests).
    """
    rows = docs.select(F.col(id_column), F.col(text_column))
    (own,) = (c for c, name in zip(carried(rows), rows.columns) if name != text_column)
    found = cleaned(rows, text_column, window, with_text=False)
    return found.select(F.col(own).alias(id_column), "n_words", "n_removed", "kept_sha256")


def without_repeats(
    docs: DataFrame, text_column: str = "text", window: int = WINDOW, length_column: str | None = None
) -> DataFrame:
    """The rows of `docs` with the repeated words cut out of their texts; kept words keep the
    space before them, other texts stay as they are (a null one too). Rows stay, even where
    nothing of their text does. `length_column` gets the new number of characters."""
    found = cleaned(docs, text_column, window)
    changed = F.col("n_removed") > 0
    columns = []
    for ours, name in zip(carried(docs), docs.columns):
        value = F.col("text" if name == text_column else ours)
        if name == length_column:
            value = F.when(changed, F.length("text").cast(docs.schema[name].dataType)).otherwise(value)
        columns.append(value.alias(name))
    return found.select(*columns)
