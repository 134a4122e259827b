"""Chat formatting by incremental black-box rendering.

A template is any function from turns (`(role, text)`, the first one first) to a string; nothing
is known of its inside. Successive prefixes of a conversation are rendered and consecutive
outputs compared: what a turn adds is its span. Two renderings of the turn with one-letter texts
show where in the span its text stands. A template rewrites history where an output does not
begin with the one before it; such turns are marked, and say from where on the output
was replaced. `out[:start] + piece`, turn by turn, is the template's output in any case.

Prefixes of a conversation of n turns are n^2 / 2 turns of rendering. Behind `WINDOW` turns a
conversation therefore goes on from its last `CONTEXT` turns only. That is exact for a template that
states of how many turns before it a turn's rendering depends (`memory`, of `marked_turns` none): time is in
proportion to the conversation, memory is a window's, and a statement found false is an error.

Of any other template nothing is known, so turns behind the first window are held until they are
proved: what a turn adds must be the same behind the context as behind the whole window, wherever a
window ends, and what was said must be the template's output of all turns, at twice the window, at
every double of that, and at the end. Where one of these fails, all prefixes of the conversation are
rendered whole, in n^2 / 2 turns. Either way the pieces make the template's output of the whole
conversation; a window of None renders all prefixes whole from the start. Memory is a conversation's,
as a template of unknown memory needs all its turns.

One task streams a conversation. Order of turns: turn (nulls first), role,
text. Null texts and roles are empty; repeated rows are turns of their own; a null
conversation id is an id like others. Other columns are not carried; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import streamed, whole_text

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Turns rendered from one start, and turns before a later start.
WINDOW, CONTEXT = 64, 2
#: Texts that tell where a turn's text stands: they differ in every character.
PROBES = ("a", "b")
#: Roles whose texts are under the loss mask.
TRAINED = ("assistant",)

_OPEN, _CLOSE = "### ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_CONTROL_IN_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+):\n((?:[^\\<]+|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def marked_turns(turns: list[Turn]) -> str:
    """The template of this library: `### role:`, the text, `</turn>`.

    A control string inside a role or text has a backslash before it, as a backslash has.
    """
    return "".join(
        f"{_OPEN}{_CONTROL_IN_ROLE.sub(_escape, role)}:\n{_CONTROL.sub(_escape, text)}{_CLOSE}\n" for role, text in turns
    )


#: Turns before a turn that what it adds depends on.
marked_turns.memory = 0


def _escape(found: re.Match) -> str:
    return "\\" + found[0]


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns of an output of `marked_turns`; a ValueError where it is none."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        yield unescaped(found[1]), unescaped(found[2])
        at = found.end()


def common_prefix(a: str, b: str) -> int:
    """Characters in which both begin alike."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


class Incremental:
    """Turns of one conversation, rendered one after the other."""

    def __init__(self, template: Template, window: int | None = WINDOW, context: int = CONTEXT):
        self.template, self.context = template, context
        self.window = None if window is None else max(window, context + 1)
        self.turns: list[Turn] = []
        self.output = template([])
        self.total = len(self.output)
        self.added = self.output
        self.begun = False
        #: Whether a turn looked different behind the context than behind its window.
        self.doubted = False

    def push(self, turn: Turn) -> dict:
        """`role`, `start`, `piece`, place of the turn's text in the output, and whether history was rewritten.

        The first piece holds what the template says before any turn.
        """
        moved = self.window is not None and len(self.turns) >= self.window and self._move()
        self.doubted |= moved
        after = self.template([*self.turns, turn])
        same = common_prefix(self.output, after)
        rewritten = same < len(self.output) or moved
        # Places in the window's output become places in the whole.
        shift = self.total - len(self.output)
        inside = self._inside(turn, same, after)
        piece = after[same:]
        out = {
            "role": turn[0],
            "start": shift + same,
            "piece": piece,
            "text_start": None if inside is None else shift + inside[0],
            "text_end": None if inside is None else shift + inside[1],
            "rewritten": rewritten,
        }
        if not self.begun:
            out["start"], out["piece"], self.begun = 0, after, True
        self.turns.append(turn)
        self.output, self.added, self.total = after, piece, shift + len(after)
        return out

    def _move(self) -> bool:
        """Go on from the last turns only; whether the last one would have looked different there."""
        kept = self.turns[len(self.turns) - self.context :]
        output = self.template(kept)
        before = self.template(kept[:-1])
        different = bool(kept) and output[common_prefix(before, output) :] != self.added
        self.turns, self.output = kept, output
        return different

    def _inside(self, turn: Turn, same: int, after: str) -> tuple[int, int] | None:
        """Where the turn's text stands in `after`; None if the template shows it nowhere in one piece."""
        one, other = (self.template([*self.turns, (turn[0], probe)]) for probe in PROBES)
        head = common_prefix(one, other)
        tail = common_prefix(one[:head:-1], other[:head:-1])
        start, end = head, len(after) - tail
        if head == min(len(one), len(other)) or not same <= start <= end:
            return None
        if after[:start] != one[:head] or (tail and after[end:] != one[len(one) - tail :]):
            return None
        return start, end


def patched(pieces: Iterable[dict]) -> str | None:
    """The output that the pieces make; None where they make none."""
    said, length = [], 0
    for made in pieces:
        if not 0 <= made["start"] <= length:
            return None
        while length > made["start"]:
            last = said.pop()
            length -= len(last)
            if length < made["start"]:
                said.append(last[: made["start"] - length])
                length = made["start"]
        said.append(made["piece"])
        length += len(made["piece"])
    return "".join(said)


def rendered(
    template: Template, turns: Iterable[Turn], window: int | None = WINDOW, context: int = CONTEXT
) -> Iterator[dict]:
    """What `Incremental.push` tells of each turn, whose pieces make the template's output of any length."""
    turns = iter(turns)
    memory = getattr(template, "memory", None)
    if window is None or memory is not None:
        so_far = Incremental(template, window, max(context, (memory or 0) + 1))
        for turn in turns:
            yield so_far.push(turn)
            if so_far.doubted:
                raise ValueError(f"the template depends on more than {memory} turns before a turn")
        return
    so_far = Incremental(template, window, context)
    seen, made, due = [], [], 2 * so_far.window
    for turn in turns:
        seen.append(turn)
        made.append(so_far.push(turn))
        if len(seen) <= so_far.window:
            yield made[-1]
        if so_far.doubted:
            break
        if len(seen) == due:
            if patched(made) != template(seen):
                break
            due *= 2
    else:
        if len(seen) <= so_far.window or patched(made) == template(seen):
            yield from made[so_far.window :]
            return
    whole = Incremental(template, None)
    for place, turn in enumerate(chain(seen, turns)):
        again = whole.push(turn)
        if place >= so_far.window:
            yield again


_PIECE = "place long, role string, start long, piece string, text_start long, text_end long, loss boolean, rewritten boolean"


def format_conversations(
    rows: DataFrame,
    template: Template = marked_turns,
    trained: Iterable[str] = TRAINED,
    window: int | None = WINDOW,
    context: int = CONTEXT,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row of each turn, each partition in order of conversations and turns.

    `conv_id, place, role, start, piece`: `out[:start] + piece` is the output with this turn.
    `text_start, text_end`: where the turn's text stands in the whole output, as the template wrote it;
    null where it cannot be told. `loss`: whether it is under the loss mask.
    `rewritten`: the turn changed what was said before it.
    """
    masked = frozenset(trained)
    dealt = rows.select(
        F.col(f"`{conversation}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        whole_text(F.col(f"`{role}`")).alias("role"),
        whole_text(F.col(f"`{text}`")).alias("text"),
    ).repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def formatted(found: Iterator[dict]) -> Iterator[dict]:
        for key, own in groupby(found, key=lambda row: row["conv_id"]):
            turns = ((row["role"], row["text"]) for row in own)
            for place, made in enumerate(rendered(template, turns, window, context)):
                loss = made["role"] in masked and made["text_start"] is not None
                yield {"conv_id": key, "place": place, "loss": loss, **made}

    return streamed(dealt.select("conv_id", "role", "text"), formatted, _PIECE)


_READ = (
    "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean"
)


def read_back(pieces: DataFrame) -> DataFrame:
    """What the output of `marked_turns` says of each conversation: its turns, and the text under the mask.

    Of rows that lie in order, as `format_conversations` leaves them. Turns are parsed from the pieces alone,
    texts under the mask are cut out of them and unescaped.
    """

    def read(found: Iterator[dict]) -> Iterator[dict]:
        for key, own in groupby(found, key=lambda row: row["conv_id"]):
            turns, masked = hashlib.sha256(), hashlib.sha256()
            out = dict.fromkeys(("n_turns", "loss_chars", "formatted_chars"), 0) | {"rewritten": False}
            for row in own:
                for role, text in read_turns(row["piece"]):
                    out["n_turns"] += 1
                    turns.update(f"{role}\n{text}\n".encode())
                if row["loss"]:
                    said = unescaped(row["piece"][row["text_start"] - row["start"] : row["text_end"] - row["start"]])
                    out["loss_chars"] += len(said)
                    masked.update(said.encode())
                out["formatted_chars"] = row["start"] + len(row["piece"])
                out["rewritten"] |= row["rewritten"]
            yield {"conv_id": key, **out, "turns_sha256": turns.hexdigest(), "loss_sha256": masked.hexdigest()}

    return streamed(pieces, read, _READ)
