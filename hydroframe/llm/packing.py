"""Best-fit packing by a configuration linear program over the length histogram.

A configuration is what one sequence holds: so many pieces of some lengths, together at
most the capacity. The program wants the fewest sequences that cover the histogram. It is
solved by multiplicative weights: a knapsack dynamic program prices configurations by the
lengths' weights, and weights fall with what is covered already. Whole numbers of the
configurations found are taken, what is left is solved again, and the last pieces are put
best-fit, longest first, into what has room, equal ones together.

The driver solves over the histogram only, at most `capacity` numbers however large the
corpus. Pieces get their places by their rank among pieces of equal length, from counts of
each task's part: no length, however frequent, meets in one task.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroframe.llm.common import small_batches, stored, whole_text
from hydroframe.llm.wordstore import Words, WordStore, blocks

CAPACITY, END = 4096, 1
#: Characters of the texts encoded together, if one text has not more.
BLOCK = 4_000_000
#: Rounds of weights in a solution, and solutions of what rounding leaves over.
ROUNDS, SOLUTIONS = 12, 4
#: Bytes of a slot in a broadcast table, and the largest table that is broadcast.
SLOT_BYTES, BROADCAST_LIMIT = 128, 64 << 20


#: Letters that stay one letter when they are lower-cased: those of most European words.
_LETTER = re.compile("[A-Za-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]").fullmatch


def _one_word(core: str) -> bool:
    """Of letters only, in lower case and composed as well."""
    return core.isalpha() and (core.isascii() or unicodedata.normalize("NFC", core).lower().isalpha())


class WordTokens(WordStore):
    """Encodes by a `tokenizers` model that drops white space and marks word ends.

    Texts are cut at blanks and line ends, which such a model never joins over. Words of
    letters are encoded many in one call: each ends with its one token of a word end. Added
    tokens that a text spells out are those tokens, as the library has it: texts are cut
    there first, and such a token is a word of its own, a blank and its id.
    """

    remembered, characters_remembered = 700_000, 10_000_000

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        # What is left of a text between added tokens holds none, whatever lower case makes of it.
        self.model.encode_special_tokens = True
        self.added = {token.content: f" {n}" for n, token in self.model.get_added_tokens_decoder().items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if self.added else None
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        super().__init__()

    def cut(self, text: str) -> Iterator[list[str]]:
        if self.at_added is None or not any(token in text for token in self.added):
            yield from self._cut(text)
            return
        for at, part in enumerate(self.at_added.split(text)):
            if at % 2:
                yield [self.added[part]]
            else:
                yield from self._cut(part)

    def _cut(self, text: str) -> Iterator[list[str]]:
        # The model lower-cases; A-Z are lower-cased here, so that fewer words differ.
        text = text.encode().lower().decode().replace("\n", " ")
        if len(text) <= BLOCK:
            yield text.split(" ")
            return
        start = 0
        while start < len(text):
            end = text.find(" ", start + BLOCK)
            end = len(text) if end < 0 else end
            yield text[start:end].split(" ")
            start = end + 1

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A final `.` or `,` behind a Latin letter is a word of its own."""
        cores = Words()
        number, none, numbers = cores.__getitem__, cores[""], []
        for word in words:
            core = word.rstrip(".,")
            if core == word or not _LETTER(core[-1:]):
                numbers += (number(word), none)
            else:
                numbers += (number(core), number(word[len(core) :]))
        parts = np.array(numbers, dtype=np.int64).reshape(-1, 2)
        tokens, starts, sizes = self._encoded(list(cores))
        flat = parts.ravel()
        shift = starts[flat] - (np.cumsum(sizes[flat]) - sizes[flat])
        together = tokens[np.repeat(shift, sizes[flat]) + np.arange(sizes[flat].sum())]
        return together, sizes[parts].sum(axis=1)

    def _encoded(self, cores: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All tokens, and where each word's begin and how many they are."""
        plain = [n for n, core in enumerate(cores) if _one_word(core)]
        runs = [plain[at : at + 500] for at in range(0, len(plain), 500)]
        joined = [" ".join([cores[n] for n in run]) for run in runs]
        order, found, sizes = [], [np.empty(0, dtype="<u4")], [np.empty(0, dtype=np.int64)]
        for run, made in zip(runs, self.model.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(made.ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) == len(run):  # else the model knows a letter as something else
                order += run
                found.append(ids)
                sizes.append(np.diff(ends, prepend=-1))
        chosen = set(order)
        others = [n for n in range(len(cores)) if n not in chosen]
        words = [n for n in others if not cores[n].startswith(" ")]
        told = self.model.encode_batch_fast([cores[n] for n in words], add_special_tokens=False)
        ids_of = dict(zip(words, (x.ids for x in told)))
        made = [ids_of[n] if n in ids_of else [int(cores[n])] for n in others]
        found.append(np.array([i for ids in made for i in ids], dtype="<u4"))
        sizes.append(np.array([len(ids) for ids in made], dtype=np.int64))
        order, by_order = np.array(order + others, dtype=np.int64), np.concatenate(sizes)
        starts, lengths = np.empty_like(order), np.empty_like(order)
        starts[order], lengths[order] = np.cumsum(by_order) - by_order, by_order
        return np.concatenate(found), starts, lengths


_LOADED: dict[int, WordTokens] = {}


def _model(data: str) -> WordTokens:
    """One model in a Python worker, with the words it knows."""
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordTokens(data)
    return _LOADED[key]


def pieces(
    docs: DataFrame, model_path: str, id_column: str, text_column: str, capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """`id`, `piece`, `start`, `length`, `ids_crc32` of every document's pieces, and for
    ranks the part of the input and the place among the part's pieces of this length."""
    with open(model_path, encoding="utf-8") as file:
        sent = docs.sparkSession.sparkContext.broadcast(file.read())
    names = ["id", "piece", "start", "length", "ids_crc32", "part", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = _model(sent.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        last = int(end).to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, behind in blocks(texts, BLOCK):
                rows: list[tuple] = []
                for row, ids in enumerate(model.block(texts[first:behind])):
                    ids += last
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        data = ids[at : at + 4 * capacity]
                        length = len(data) // 4
                        rows.append((row, piece, at // 4, length, zlib.crc32(data), seen[length]))
                        seen[length] += 1
                row, piece, start, length, crc, place = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, behind - first).take(pa.array(row)),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.repeat(pa.scalar(part, pa.int64()), len(rows)),
                        pa.array(place, pa.int64()),
                    ],
                    names,
                )
        model.forget()  # idle workers keep no words

    read = small_batches(docs).select(F.col(id_column).alias("id"), whole_text(F.col(text_column)).alias("text"))
    kind = read.schema[0].dataType.simpleString()
    return read.mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, part long, place long"
    )


#: Lengths, longest first, and how many of each; and how many sequences are filled so.
Configuration = tuple[tuple[int, int], ...]


def _knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best price of what fits into each room, and the length taken last (0: none).

    `prices[l]` is the price of a piece of length l, -inf where there is none."""
    capacity = len(prices) - 1
    best, taken = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    by_length = prices[1:]
    for room in range(1, capacity + 1):
        worth = by_length[:room] + best[room - 1 :: -1]
        length = int(worth.argmax())
        if worth[length] > best[room - 1]:
            best[room], taken[room] = worth[length], length + 1
        else:
            best[room] = best[room - 1]
    return best, taken


def _configuration(length: int, taken: np.ndarray, capacity: int) -> Configuration:
    """The best configuration that has a piece of this length."""
    room, found = capacity - length, defaultdict(int)
    found[length] += 1
    while room > 0:
        if taken[room]:
            found[int(taken[room])] += 1
            room -= int(taken[room])
        else:
            room -= 1
    return tuple(sorted(found.items(), reverse=True))


def _weighted(demand: np.ndarray, rounds: int) -> dict[Configuration, float]:
    """The program's solution by multiplicative weights: configurations and how often each."""
    capacity = len(demand) - 1
    lengths = np.flatnonzero(demand)
    size = lengths / capacity
    weight = size * (1 + 0.05 * size)  # long pieces first, as they are harder to place
    covered, found = np.zeros(capacity + 1), defaultdict(float)
    for n in range(1, rounds + 1):
        prices = np.full(capacity + 1, -np.inf)
        prices[lengths] = weight
        _, taken = _knapsack(prices)
        for length in lengths[::-1].tolist():
            missing = demand[length] * n / rounds - covered[length]
            if missing <= 0:
                continue
            configuration = _configuration(length, taken, capacity)
            times = min(missing, min(demand[l] / k for l, k in configuration))
            found[configuration] += times
            for l, k in configuration:
                covered[l] += k * times
        weight *= np.exp(-0.2 * np.clip(covered[lengths] / demand[lengths] - n / rounds, -1, 1))
    return found


def _take(
    found: dict[Configuration, int], left: np.ndarray, configuration: Configuration, times: int
) -> None:
    """The configuration `times` times, without the pieces of which no more are left."""
    while times > 0:
        configuration = tuple((l, min(k, int(left[l]))) for l, k in configuration if left[l])
        if not configuration:
            return
        now = min(times, *(int(left[l]) // k for l, k in configuration))
        found[configuration] += now
        for l, k in configuration:
            left[l] -= k * now
        times -= now


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Configuration, int]]:
    """Configurations and how many sequences each fills; every piece has exactly one place.

    Configurations that fill a sequence waste nothing and are taken first, round after round.
    Of what they leave, the program's solution is rounded down whatever it fills, and the rest
    solved again, so that the last best-fit has no more pieces than configurations hold; a
    histogram of any size takes this way. Rounding may cost more than the
    program gains: the fewest sequences of both, and of the first solution rounded alone, count.
    """
    every = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        every[length] = n
    full: dict[Configuration, int] = defaultdict(int)
    left, first = every.copy(), None
    for _ in range(SOLUTIONS):
        if not left.any():
            break
        before = left.sum()
        solution = sorted(_weighted(left, ROUNDS).items(), key=lambda x: -x[1])
        first = first or solution
        for configuration, wanted in solution:
            fits = min(int(left[l]) // k for l, k in configuration)
            if fits and sum(l * k for l, k in configuration) >= capacity * 0.999:
                _take(full, left, configuration, min(fits, int(np.ceil(wanted))))
        if left.sum() > 0.9 * before:
            break
    plans = [_best_fit(full, left)]
    for found, rest, solution in ((full.copy(), left, None), (defaultdict(int), every, first)):
        if rest.any():
            rest = rest.copy()
            _round(found, rest, solution)
            plans.append(_best_fit(found, rest))
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _round(
    found: dict[Configuration, int], rest: np.ndarray, solution: list[tuple[Configuration, float]] | None
) -> None:
    """Take what a solution holds whole, then what a solution of the rest does, a few times.

    Where none holds a whole sequence, of a few pieces left, the configurations of more than half a
    sequence are taken, the largest share first.
    """
    for _ in range(SOLUTIONS):
        if not rest.any():
            return
        solution = solution or sorted(_weighted(rest, ROUNDS).items(), key=lambda x: -x[1])
        least = 1 if solution[0][1] >= 1 else 0.5
        for configuration, wanted in solution:
            if wanted >= least:
                fits = min(int(rest[l]) // k for l, k in configuration)
                _take(found, rest, configuration, int(wanted) if least == 1 else min(fits, 1))
        solution = None


def _best_fit(found: dict[Configuration, int], left: np.ndarray) -> list[tuple[Configuration, int]]:
    """The sequences found, and what is left: longest first, each piece into the fullest
    sequence that has room, else into a new one.

    Equal sequences are one group of (pieces by length, times). Equal pieces fill a group at
    once, so that the work is bounded by lengths and groups. A number's bits tell the rooms
    that occur, so that the smallest that fits is its lowest bit."""
    capacity = len(left) - 1
    with_room: dict[int, list[tuple[Configuration, int]]] = defaultdict(list)
    rooms, made = 0, defaultdict(int)

    def put(configuration: Configuration, times: int, room: int) -> None:
        nonlocal rooms
        if times and room:
            with_room[room].append((configuration, times))
            rooms |= 1 << room
        elif times:
            made[configuration] += times

    for configuration, times in found.items():
        put(configuration, times, capacity - sum(l * k for l, k in configuration))
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fitting = rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                configuration, times = with_room[room].pop()
                if not with_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, configuration = capacity, ()
                times = -(-n // (capacity // length))
            most = min(room // length, n)
            whole = min(times, n // most)
            spare = min(n - whole * most, most) if whole < times else 0
            for copies, filled in ((most, whole), (spare, 1 if spare else 0)):
                held = dict(configuration)
                held[length] = held.get(length, 0) + copies
                put(tuple(sorted(held.items(), reverse=True)), filled, room - copies * length)
            put(configuration, times - whole - (1 if spare else 0), room)
            n -= whole * most + spare
    for group in with_room.values():
        for configuration, times in group:
            made[configuration] += times
    return sorted(made.items())


def _slots(plan: list[tuple[Configuration, int]]) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(length, first rank, behind its last rank, copies, first sequence, first offset) of each
    length in each configuration: which ranks of the length go there, and where to."""
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for configuration, times in plan:
        offset = 0
        for length, copies in configuration:
            rank = used[length]
            used[length] += copies * times
            yield length, rank, used[length], copies, sequence, offset
            offset += copies * length
        sequence += times


def pack(
    docs: DataFrame,
    model_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """The id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document is its ids and `end`; only a longer one is cut, into pieces of the capacity
    and a rest. Null and empty texts are a piece of the end alone. Repeated rows are packed
    each; an empty table gives no rows; other columns are ignored.

    Pieces are written once, before they are counted, so that a task that runs again cannot
    number them otherwise. The driver gets one number for each length. The table of slots
    has as many rows as configurations have lengths: each solution finds at most one
    configuration for a length and round, of which rounding and best-fit make some more, so
    the bound is in proportion to capacity x ROUNDS x SOLUTIONS, whatever the corpus.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, model_path, id_column, text_column, capacity, end), "pieces")
    counted = stored(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    places = list(_slots(solve(histogram, capacity)))
    table_bytes = len(places) * SLOT_BYTES
    slots = spark.createDataFrame(
        places,
        "slot_length long, low long, high long, copies long, sequence long, base long",
    )
    ranked = cut.join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("place"))
    here = (ranked["length"] == F.col("slot_length")) & F.col("rank").between(F.col("low"), F.col("high") - 1)
    nth = F.col("rank") - F.col("low")
    if table_bytes <= BROADCAST_LIMIT:
        slots = F.broadcast(slots)
    return ranked.join(slots, here).select(
        F.col("id").alias(id_column),
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("copies") * ranked["length"]).cast("long").alias("offset"),
    )
