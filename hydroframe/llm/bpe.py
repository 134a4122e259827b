"""Byte-level BPE: encoding by merge replay over an inverted index, and decoding.

The words of a block of documents are gathered once each. An index tells, for each token
pair (named by the rank of its merge), where in those words it stands. Merges are applied
in rank order, each at all its places at once, and only the two neighbours of a merged
pair are looked up again. Documents are then put together from their words' ids.

Merges never cross a word, so the replay over a block's words gives what the replay over
the whole corpus's words would. Blocks need no shuffle, a task holds one block, and
remembers words it has encoded up to a bound.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import small_batches, whole_text
from hydroframe.llm.wordstore import WordStore, blocks

#: Characters of the texts whose words are replayed together, if one text has not more.
BLOCK = 4_000_000
#: Words of one longer text gathered at once.
WORDS = 250_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and their ranks: a line has a token in base 64 and its rank."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens that makes a token: sorted keys (left << 32 | right) and ranks."""
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left = ranks.get(token[:cut])
            if left is not None and (right := ranks.get(token[cut:])) is not None:
                found[left << 32 | right] = rank
    keys = np.array(sorted(found), dtype=np.int64)
    return keys, np.array([found[k] for k in keys.tolist()], dtype=np.int32)


class Replay(WordStore):
    """Encodes texts by the ranks, and remembers words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.keys, self.key_ranks = merge_table(ranks)
        super().__init__()

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; -1 if there is none."""
        if not len(self.keys):
            return np.full(len(left), -1, dtype=np.int32)
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.key_ranks[at], -1)

    def replay(self, words: list[bytes], one_by_one: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words and how many each has.

        A merge may make a pair of earlier rank possible (in ranks that were not trained
        together with their merges). Then the later places of the merge in that word have
        to wait: such words are replayed again, in each round only with a word's first place.
        """
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        n, ends = len(data), np.cumsum(lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        token = self.single[data]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        inner = word[1:] == word[:-1]
        after[:-1][~inner] = -1
        before[1:][~inner] = -1
        after[n - 1 :] = -1
        pair = np.full(n, -1, dtype=np.int32)
        left = np.flatnonzero(inner).astype(np.int32)
        pair[left] = self.rank(token[left], token[left + 1])
        again = np.zeros(len(words), dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def index(where: np.ndarray) -> None:
            """Add these places under the rank of their pair."""
            where = where[pair[where] >= 0]
            if len(where) > 1:
                where = where[np.argsort(pair[where], kind="stable")]
                found = pair[where]
                parts = np.split(where, np.flatnonzero(found[1:] != found[:-1]) + 1)
            else:
                parts = [where] if len(where) else []
            for part in parts:
                q = int(pair[part[0]])
                if q in places:
                    places[q].append(part)
                else:
                    places[q] = [part]
                    heappush(ranks, q)

        index(left)
        while ranks:
            r = heappop(ranks)
            parts = places.pop(r)
            where = parts[0] if len(parts) == 1 else np.concatenate(parts)
            where = where[pair[where] == r]  # not those whose tokens have been merged meanwhile
            if len(where) > 1:
                where = np.unique(where)
                if one_by_one:
                    first = np.concatenate([[True], word[where[1:]] != word[where[:-1]]])
                    if not first.all():
                        index(where[~first])
                    where = where[first]
                else:  # of overlapping pairs the first, the third and so on
                    overlaps = after[where[:-1]] == where[1:]
                    if overlaps.any():
                        at = np.arange(len(where))
                        begins = np.concatenate([[True], ~overlaps])
                        where = where[(at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0]
            if not len(where):
                continue
            gone = after[where]
            later = after[gone]
            beside = np.flatnonzero(later[:-1] == where[1:])  # the next place starts right behind
            if len(beside):
                q = self.rank(np.full(len(beside), r), token[later[beside]])
                again[word[where[beside[(q >= 0) & (q < r)]]]] = True
            token[where], pair[gone] = r, -2
            after[where] = later
            last = later < 0
            before[later[~last]] = where[~last]
            pair[where[last]] = -1
            earlier = before[where]
            touched = np.concatenate([where[~last], earlier[earlier >= 0]])
            if len(touched):
                pair[touched] = q = self.rank(token[touched], token[after[touched]])
                index(touched)
                if (low := (q >= 0) & (q < r)).any() and not one_by_one:
                    again[word[touched[low]]] = True
        alive = pair != -2
        kept, total = token[alive].astype("<u4"), np.concatenate([[0], alive.cumsum()])
        counts = np.diff(np.concatenate([[0], total[ends]]))
        if again.any():
            redone, sizes = self.replay([w for w, x in zip(words, again) if x], one_by_one=True)
            parts = np.split(kept, np.cumsum(counts)[:-1])
            for at, new in zip(np.flatnonzero(again), np.split(redone, np.cumsum(sizes)[:-1])):
                parts[at], counts[at] = new, len(new)
            kept = np.concatenate(parts)
        return kept, counts

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A word that is a token has its own id, any other is replayed."""
        new = [w.encode() for w in words]
        whole = np.array([self.ranks.get(w, -1) for w in new], dtype=np.int64)
        merged, counts = self.replay([w for w, known in zip(new, whole) if known < 0])
        sizes = np.ones(len(new), dtype=np.int64)
        sizes[whole < 0] = counts
        tokens = np.repeat(whole, sizes)
        tokens[tokens < 0] = merged
        return tokens, sizes

    def cut(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK:
            yield self.pattern.findall(text)
            return
        found = self.pattern.finditer(text)
        while words := [m.group() for m in islice(found, WORDS)]:
            yield words


#: What a Python worker has loaded, so that its next tasks need not.
_LOADED: dict[tuple, object] = {}


def _replay_of(data: bytes, pattern: str) -> Replay:
    key = (hash(data), len(data), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Replay(read_ranks(data), pattern)
    return _LOADED[key]


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The id and `ids`, the whole text's token ids as little-endian unsigned 32-bit integers.

    `ranks_path`: a file of tokens and ranks the driver can read; it is sent to the
    executors (a vocabulary of fixed size). Each match of `pattern` is encoded by itself;
    special tokens are ordinary text. Null and empty texts have no ids. Repeated rows are
    encoded alike, an empty table gives no rows, other columns are ignored.
    """
    with open(ranks_path, "rb") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _replay_of(sent.value, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, end in blocks(texts, BLOCK):
                ids = replay.block(texts[start:end])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array(ids, pa.binary())],
                    [id_column, "ids"],
                )
        replay.forget()  # idle workers keep no words

    read = small_batches(docs).select(F.col(id_column), whole_text(F.col(text_column)))
    kind = read.schema[0].dataType.simpleString()
    return read.mapInArrow(run, f"`{id_column}` {kind}, ids binary")


def decode(encoded: DataFrame, ranks_path: str, ids_column: str = "ids") -> DataFrame:
    """All columns and `decoded`, the bytes of the ids. Null ids give null; an unknown id is an error."""
    with open(ranks_path, "rb") as file:
        sent = encoded.sparkSession.sparkContext.broadcast(file.read())
    at = encoded.columns.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {rank: token for token, rank in read_ranks(sent.value).items()}
        for batch in batches:
            decoded = [
                None if ids is None else b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
                for ids in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")
