"""Conversation structure repair: the cheapest edits that make roles alternate, and what was wrong.

A conversation's roles shall read `(s?(ua)+)?` by their first characters. Every row is a symbol: its
role's initial and its fault. Equal consecutive symbols are one run. The costs of one symbol
are a matrix between the four states of that pattern, in (min, +); a run costs a product of
cached binary powers of it. Walking back over the runs gives the cost left at each of their
ends, and from there a walk forward unrolls the choices, halving each run at such powers, into
the least audit string among the cheapest: D (delete), I (insert), K (keep) or R (rerole) for
each edit.

Rows are told apart by digests; equal rows of a turn are counted before any shuffle, and
symbols are dealt by ranges of (conversation, turn), so that a conversation of any size is read
by several tasks, which hand on runs only. Its audit is one cell of the result, so its runs
meet in one task. Texts are shuffled once, to be written out in order, by a stream that holds one batch.

Order of rows: turn (nulls first), role, then the text's first characters and digest. A row's first fault
counts: blank (nothing but white space), duplicate (role and text seen earlier in the
conversation), truncated (the last character that is no white space is none of `.!?`). Null
roles and texts are one blank character; a role of no known initial, the empty one included, can be
deleted or replaced only. A null conversation id is an id like others. Other columns are not
carried; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import stored, streamed

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where an inserted or replaced role leads, and the names of the roles that lead there.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Where a kept role's initial leads.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Pairs of initials that may stand side by side.
LEGAL = {"su", "ua", "au"}
#: Symbols: `-` must go; else the initial (`?` if unknown), and whether the row is truncated.
MUST_GO = ("-", False)
WHITE = " \t\n\x0b\x0c\r"
#: First characters of a text that order rows of one turn and role.
HEAD = 32

Matrix = tuple[tuple[float, ...], ...]
Vector = tuple[float, ...]
NEVER = float("inf")


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def applied(a: Matrix, v: Vector) -> Vector:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


def _inserts() -> Matrix:
    """Cheapest insertions from state to state."""
    costs = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        at, cost = state, 0
        for _ in range(4):
            costs[state][at] = min(costs[state][at], cost)
            at, cost = NEXT[at], cost + INSERT
    return tuple(map(tuple, costs))


INSERTS = _inserts()
#: Cost left behind the last row.
END = applied(INSERTS, (0, NEVER, NEVER, 0))


def choices(symbol: tuple[str, bool], state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a row in a state, by their letters: letter, cost, state after it."""
    yield "D", DELETE, state
    if symbol != MUST_GO:
        stays = TRUNCATED if symbol[1] else 0
        kept = KEPT.get(symbol[0], {}).get(state)
        if kept is not None:
            yield "K", stays, kept
        yield "R", REROLE + stays, NEXT[state]


@lru_cache(maxsize=None)
def power(symbol: tuple[str, bool], exponent: int) -> Matrix:
    """Costs of 2**exponent rows of a symbol, insertions before each included."""
    if exponent:
        half = power(symbol, exponent - 1)
        return times(half, half)
    costs = [[NEVER] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, after in choices(symbol, state):
            costs[state][after] = min(costs[state][after], cost)
    return times(INSERTS, tuple(map(tuple, costs)))


def before(symbol: tuple[str, bool], length: int, after: Vector) -> Vector:
    """Cost left before `length` rows of a symbol, given the cost left behind them."""
    exponent = 0
    while length:
        if length & 1:
            after = applied(power(symbol, exponent), after)
        length, exponent = length >> 1, exponent + 1
    return after


def unroll(symbol: tuple[str, bool], length: int, state: int, after: Vector, audit: list[str]) -> int:
    """Append the least letters among the cheapest for a run; the state behind it."""
    if length > 1:
        half = 1 << ((length - 1).bit_length() - 1)
        middle = before(symbol, length - half, after)
        state = unroll(symbol, half, state, middle, audit)
        return unroll(symbol, length - half, state, after, audit)
    left = applied(power(symbol, 0), after)
    while True:
        # D comes before I, I before K and R.
        (_, cost, _), *others = choices(symbol, state)
        if cost + after[state] == left[state]:
            audit.append("D")
            return state
        if INSERT + left[NEXT[state]] == left[state]:
            audit.append("I")
            state = NEXT[state]
            continue
        letter, _, state = next(x for x in others if x[1] + after[x[2]] == left[state])
        audit.append(letter)
        return state


def cheapest(runs: list[tuple[tuple[str, bool], int]]) -> tuple[int, str]:
    """The least cost, and the least audit of that cost, of a conversation's runs."""
    left = [END]
    for symbol, length in reversed(runs):
        left.append(before(symbol, length, left[-1]))
    audit: list[str] = []
    state = START
    for (symbol, length), after in zip(runs, left[-2::-1]):
        state = unroll(symbol, length, state, after, audit)
    while END[state]:
        audit.append("I")
        state = NEXT[state]
    return int(left[-1][START]), "".join(audit)


def merged(runs: Iterable[tuple[tuple[str, bool], int]]) -> list[tuple[tuple[str, bool], int]]:
    """Runs with equal neighbours made one, empty ones left out."""
    out: list[tuple[tuple[str, bool], int]] = []
    for symbol, length in runs:
        if out and out[-1][0] == symbol:
            out[-1] = (symbol, out[-1][1] + length)
        elif length:
            out.append((symbol, length))
    return out


def ordered_rows(rows: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows with nulls replaced, and the columns that order and tell apart rows of a turn."""
    return rows.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"),
    ).select(
        "conv_id",
        "turn",
        "role",
        F.left("text", F.lit(HEAD)).alias("head"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
        "text",
    )


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("digest")]


def symbol_rows(rows: DataFrame) -> DataFrame:
    """Every different row of a turn once: its number of copies, whether blank or truncated, whether seen before."""
    ended = F.rtrim("text", F.lit(WHITE))
    said = rows.select(
        "conv_id",
        "turn",
        "role",
        "head",
        "digest",
        (ended == "").alias("blank"),
        (~F.right(ended, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    each = said.groupBy(said.columns).agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull().alias("dated"), F.col("turn"))
    firsts = each.groupBy(
        F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")
    ).agg(F.min(place).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return each.join(firsts, same).select(*each.columns, (~place.eqNullSafe(F.col("first"))).alias("seen"))


_FACTS = "blank long, duplicate long, truncated long, illegal long"
_PIECE = (
    "piece int, symbols array<string>, cut array<boolean>, lengths array<long>, first string, last string, "
    f"low long, high long, turns long, {_FACTS}"
)


def _piece(piece: int, rows: Iterable[dict]) -> dict:
    """What a task knows of its consecutive rows of one conversation."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    out |= {"piece": piece, "first": None, "last": None, "low": None, "high": None}
    runs: list[tuple[tuple[str, bool], int]] = []

    def add(symbol: tuple[str, bool], length: int) -> None:
        runs[-1:] = merged([*runs[-1:], (symbol, length)])

    for row in rows:
        initial, copies = row["role"][:1], row["copies"]
        if out["first"] is None:
            out["first"] = initial
        elif out["last"] + initial not in LEGAL:
            out["illegal"] += 1
        out["last"] = initial
        out["illegal"] += copies - 1
        if row["turn"] is not None and row["turn"] != out["high"]:
            out["turns"] += 1
            out["high"] = row["turn"]
            out["low"] = out["high"] if out["low"] is None else out["low"]
        if row["blank"]:
            out["blank"] += copies
            add(MUST_GO, copies)
            continue
        if not row["seen"]:
            copies -= 1
            out["truncated"] += row["truncated"]
            add((initial if initial in KEPT else "?", row["truncated"]), 1)
        out["duplicate"] += copies
        add(MUST_GO, copies)
    out["symbols"] = [symbol for (symbol, _), _ in runs]
    out["cut"] = [cut for (_, cut), _ in runs]
    out["lengths"] = [length for _, length in runs]
    return out


def _joined(pieces: Iterable[dict]) -> dict:
    """The audit of a conversation from its pieces in order."""
    out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    runs: list[tuple[tuple[str, bool], int]] = []
    last = low = high = None
    turns = 0
    for piece in pieces:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            out[name] += piece[name]
        if last is not None and last + piece["first"] not in LEGAL:
            out["illegal"] += 1
        last = piece["last"]
        if piece["low"] is not None:
            turns += piece["turns"] - (piece["low"] == high)
            high = piece["high"]
            low = piece["low"] if low is None else low
        runs += [((s, c), n) for s, c, n in zip(piece["symbols"], piece["cut"], piece["lengths"])]
    out["cost"], out["audit"] = cheapest(merged(runs))
    out["gaps"] = 0 if low is None else high - low + 1 - turns
    return out


_AUDIT = f"gaps long, {_FACTS}, cost long, audit string"
_ROW = "place long, role string, text string, edit string"
_DIGEST = "rows long, sha256 string"


def audits(
    rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row of each conversation: its gaps, counts of faults, least cost and audit."""
    told = symbol_rows(ordered_rows(rows, conversation, turn, role, text))
    order = [F.col("conv_id"), *_order()]
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order)

    def pieces(found: Iterator[dict]) -> Iterator[dict]:
        number = TaskContext.get().partitionId()
        for key, own in groupby(found, key=lambda row: row["conv_id"]):
            yield {"conv_id": key, **_piece(number, own)}

    def whole(found: Iterator[dict]) -> Iterator[dict]:
        for key, own in groupby(found, key=lambda row: row["conv_id"]):
            yield {"conv_id": key, **_joined(own)}

    met = streamed(dealt, pieces, _PIECE).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return streamed(met, whole, _AUDIT)


def repaired(
    rows: DataFrame,
    found: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """`conv_id, place, role, text, edit`: the rows of the repaired conversations, each partition in order.

    `found` are the `audits` of the same rows. A conversation's audit comes before its rows,
    so that the edits are applied as the rows stream by.
    """
    ours = ordered_rows(rows, conversation, turn, role, text)
    heads = found.select(
        "conv_id", *(F.lit(None).cast(ours.schema[c].dataType).alias(c) for c in ours.columns[1:]), "audit"
    )
    both = ours.withColumn("audit", F.lit(None).cast("string")).union(heads)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())

    def edited(found: Iterator[dict]) -> Iterator[dict]:
        for key, own in groupby(found, key=lambda row: row["conv_id"]):
            audit, place, state = next(own)["audit"], 0, START
            row = None
            for letter in audit:
                if letter != "I":
                    row = next(own)
                if letter == "D":
                    continue
                state = KEPT[row["role"][:1]][state] if letter == "K" else NEXT[state]
                yield {
                    "conv_id": key,
                    "place": place,
                    "role": row["role"] if letter == "K" else NAMES[state],
                    "text": "" if letter == "I" else row["text"],
                    "edit": letter,
                }
                place += 1

    return streamed(dealt.select("conv_id", "role", "text", "audit"), edited, _ROW)


def digests(repaired_rows: DataFrame) -> DataFrame:
    """`conv_id, rows, sha256` of `role:text`, joined by newlines, of rows that lie in order, as `repaired` leaves them.

    A digest is made from first to last, so one task reads a conversation; it holds one batch.
    """

    def hashed(found: Iterator[dict]) -> Iterator[dict]:
        for key, own in groupby(found, key=lambda row: row["conv_id"]):
            digest, n = hashlib.sha256(), 0
            for row in own:
                digest.update(("\n" * (n > 0) + row["role"] + ":" + row["text"]).encode())
                n += 1
            yield {"conv_id": key, "rows": n, "sha256": digest.hexdigest()}

    return streamed(repaired_rows, hashed, _DIGEST)


def damaged(rows: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` with faults by a checksum of conversation and turn: a row in five has one."""
    known = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    fault = F.crc32(F.concat(known[0], F.lit(":"), known[1]).cast("binary")) % 20
    marked = rows.select(
        "conv_id", "turn", known[2].alias("role"), known[3].alias("text"), fault.alias("fault")
    ).where("fault != 0")
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "")
        .when(F.col("fault") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def repair_report(rows: DataFrame, every: DataFrame) -> DataFrame:
    """The audit of each conversation of `every` (`conv_id`), and the digest of its repaired rows."""
    found = stored(audits(rows), "conversation-audits")
    made = digests(repaired(rows, found)).select(F.col("conv_id").alias("made_id"), "sha256")
    wanted = every.select(F.col("conv_id").alias("wanted_id")).distinct()
    wide = wanted.join(found, F.col("wanted_id").eqNullSafe(F.col("conv_id")), "left").join(
        made, F.col("wanted_id").eqNullSafe(F.col("made_id")), "left"
    )
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return wide.select(
        F.col("wanted_id").alias("conv_id"),
        *(F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
