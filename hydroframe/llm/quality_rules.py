"""Quality rules: a decision list learned from labelled documents, as one Spark expression.

The statistics of a text are built-in expressions over its words and lines. Sequential
covering learns rules that reject: a rule grows threshold by threshold towards the pure
part of the documents not yet covered, is pruned against documents kept out of the growing,
and joins the list if it holds on them. The list becomes an ordered conditional
expression, so that judging is one projection: no shuffle and no Python over the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import WORD, aside, carried, row_of, whole_text

SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"

#: A document below this many words, or with more than this share of repeated words, fails.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50

#: At most so many labelled documents are fetched to learn from.
LABELLED = 6000

#: Up to so many repeated windows are looked up in a list.
FEW = 32

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _count_of(text: Column, characters: str) -> Column:
    """How many of the characters, given as in a regular expression's class, the text has."""
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _with_neighbour(values: Column) -> Column:
    """Pairs of each value and the next; without the last value."""
    n = F.size(values)
    return F.zip_with(
        F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a.alias("a"), b.alias("b")),
    )


def _covered(starts: Column) -> Column:
    """Words that the windows at these starts cover."""
    words = F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))
    return F.size(F.array_distinct(words))


def _twice(windows: Column) -> Column:
    """The hashes that occur twice or more: sorted, equal ones are neighbours."""
    ordered, later = F.sort_array(windows), F.greatest(F.size(windows) - 1, F.lit(0))
    equal = F.zip_with(
        F.slice(ordered, 1, later), F.slice(ordered, 2, later), lambda a, b: F.when(a == b, a)
    )
    return F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.array_distinct(F.filter(equal, lambda x: x.isNotNull())),
    ).otherwise(F.array().cast("array<bigint>"))


def _repeat_words(windows: Column, twice: Column) -> Column:
    """Words inside a window that is found twice or more; `windows`: hashes in order.

    A few repeated hashes are looked up in their list; many are found by sorting windows
    with their places, which takes n log n instead of a list's length for each window.
    """
    few = F.transform(windows, lambda w, i: F.when(F.array_contains(twice, w), i))
    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    same = F.filter(_with_neighbour(placed), lambda p: p["a"]["w"] == p["b"]["w"])
    many = F.flatten(F.transform(same, lambda p: F.array(p["a"]["i"], p["b"]["i"])))
    return (
        F.when(F.size(twice) == 0, 0)
        .when(F.size(twice) <= FEW, _covered(F.filter(few, lambda i: i.isNotNull())))
        .otherwise(_covered(many))
    )


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`row`, the input row, and `q`, a struct of the text's statistics (all of them bigint).

    A null text has no word and no line. Windows of three words are compared by 64-bit hash.
    Texts of any length take time in proportion to n log n.
    """
    text = F.col("text")
    own = carried(docs)
    split = docs.select(*aside(docs), whole_text(F.col(text_column)).alias("text")).select(
        *own,
        "text",
        F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
    )
    words, n = F.col("words"), F.size("words")
    later = F.greatest(n - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, later), F.slice(words, 2, later), lambda a, b: F.struct(a, b))
    windows = F.zip_with(pairs, F.slice(words, 3, later), lambda p, c: F.xxhash64(p, c))
    counted = split.select(*own, "text", "words", "lines", windows.alias("windows")).select(
        "*", _twice(F.col("windows")).alias("twice")
    )
    repeats = _repeat_words(F.col("windows"), F.col("twice"))
    numbers = {
        "n_words": n,
        "word_chars": F.length(text) - _count_of(text, SPACE),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeats,
        "n_lines": F.size("lines"),
        "n_upper": _count_of(text, "A-Z"),
        "n_kinds": F.size(F.array_distinct("words")),
    }
    q = F.struct(*(value.cast("long").alias(name) for name, value in numbers.items()))
    # A generator keeps filters on `q` above it, so that no statistic is worked out twice.
    return counted.select(*own, F.explode(F.array(q)).alias("q")).select(row_of(docs), "q")


def base_failed(q: str = "q") -> Column:
    words = F.col(f"{q}.n_words")
    repeated = F.col(f"{q}.n_repeat_words") * 100 > words * MOST_REPEATED_PERCENT
    return (words < LEAST_WORDS) | repeated


#: Statistic of a rule: numerator and denominator.
RATIOS = {
    "n_words": ("n_words", None),
    "mean_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "kinds_share": ("n_kinds", "n_words"),
    "lines_per_word": ("n_lines", "n_words"),
}


def statistic(name: str, q: str = "q") -> Column:
    top, bottom = RATIOS[name]
    value = F.col(f"{q}.{top}").cast("double")
    return value if bottom is None else value / F.greatest(F.col(f"{q}.{bottom}"), F.lit(1))


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, values: np.ndarray, names: list[str]) -> np.ndarray:
        column = values[:, names.index(self.name)]
        return column > self.threshold if self.above else column <= self.threshold

    def expression(self) -> Column:
        value = statistic(self.name)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


#: A rule rejects where all its conditions hold.
RuleList = list[list[Condition]]


def _covers(rule: list[Condition], values: np.ndarray, names: list[str]) -> np.ndarray:
    covered = np.ones(len(values), dtype=bool)
    for condition in rule:
        covered &= condition.holds(values, names)
    return covered


def _best(values, bad, inside, names, thresholds) -> Condition | None:
    """The condition that gains most information about the rejected ones (FOIL's measure)."""
    p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
    best, most = None, 1e-9
    if not p0 or not n0:
        return None
    before = math.log2(p0 / (p0 + n0))
    for k, name in enumerate(names):
        above = values[:, k][:, None] > thresholds[k][None, :]
        for side in (True, False):
            hit = (above if side else ~above) & inside[:, None]
            p, n = (hit & bad[:, None]).sum(axis=0), (hit & ~bad[:, None]).sum(axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), 0.0)
            at = int(gain.argmax())
            if gain[at] > most:
                best, most = Condition(name, side, float(thresholds[k][at])), gain[at]
    return best


def learn(
    values: np.ndarray,
    bad: np.ndarray,
    names: list[str],
    longest: int = 3,
    most_rules: int = 12,
    precision: float = 0.97,
    least: int = 3,
) -> RuleList:
    """Sequential covering. Each third row prunes, the others grow.

    A rule is kept if, of the rows it covers, at least `precision` are bad, in growing and
    pruning rows alike, and it covers `least` bad rows or more; the first that is not ends the list.
    Without bad or without good rows there is nothing to learn: an empty list, which keeps all.
    """
    if not len(values) or bad.all() or not bad.any():
        return []
    prune = np.arange(len(values)) % 3 == 2
    thresholds = []
    for column in values.T:
        cuts = np.unique(np.quantile(column, np.linspace(0.002, 0.998, 160), method="lower"))
        distinct = np.unique(column)
        after = distinct[np.minimum(np.searchsorted(distinct, cuts, side="right"), len(distinct) - 1)]
        thresholds.append((cuts + after) / 2)
    left, rules = np.ones(len(values), dtype=bool), []
    while len(rules) < most_rules and (bad & left).any():
        rule: list[Condition] = []
        inside = left & ~prune
        while len(rule) < longest and (found := _best(values, bad, inside, names, thresholds)):
            rule.append(found)
            inside &= found.holds(values, names)
        rule = _pruned(rule, values, bad, left & prune, names)
        covered = _covers(rule, values, names) & left if rule else np.zeros(len(values), dtype=bool)
        right = (bad & covered).sum()
        tested = covered & prune
        sure = not tested.any() or (bad & tested).sum() >= precision * tested.sum()
        if right < least or right < precision * covered.sum() or not sure:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def _pruned(rule, values, bad, where, names):
    """The first conditions of the rule that do best on the pruning rows; longer wins a tie."""
    best, most = rule, -2.0
    for length in range(1, len(rule) + 1):
        covered = _covers(rule[:length], values, names) & where
        p, n = (bad & covered).sum(), (~bad & covered).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth >= most:
            best, most = rule[:length], worth
    return best


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    most: int = LABELLED,
) -> RuleList:
    """The decision list of up to `most` labelled documents, those of the smallest id hash.

    `labels`: the id and 1 for good, 0 for bad; rows with a null in either are left out. An id
    counts once: bad if any of its labels is, and by one of its documents, that of the
    smallest text hash.
    Documents that fail the base are left out, the list is not needed for them. Only
    numbers reach the driver, at most `most` rows of them; with fewer labels, all are used.
    """
    sample = (
        labels.select(F.col(id_column).alias("id"), (F.col(label_column) == 0).alias("bad"))
        .where("id is not null and bad is not null")
        .groupBy("id")
        .agg(F.max("bad").alias("bad"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
    )
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = texts.join(F.broadcast(sample), "id").groupBy("id", "bad").agg(
        F.min_by("text", F.xxhash64("text")).alias("text")
    )
    names = list(RATIOS)
    rows = (
        with_statistics(known)
        .where(~base_failed())
        .select("row.id", "row.bad", *(statistic(name).alias(name) for name in names))
        .collect()
    )
    rows.sort(key=lambda r: tuple(r[2:]) + (r[0], r[1]))
    order = np.random.default_rng(0).permutation(len(rows))
    rows = [rows[i] for i in order]
    values = np.array([r[2:] for r in rows], dtype=float).reshape(len(rows), len(names))
    return learn(values, np.array([r[1] for r in rows], dtype=bool), names)


def rejecting_rule(rules: RuleList) -> Column:
    """Number of the first rule of the list that rejects, from 1; null if none does."""
    chosen = F
    for number, rule in enumerate(rules, 1):
        holds = rule[0].expression()
        for condition in rule[1:]:
            holds &= condition.expression()
        chosen = chosen.when(holds, F.lit(number))
    return chosen.otherwise(F.lit(None).cast("int")) if rules else F.lit(None).cast("int")


def judge(docs: DataFrame, rules: RuleList, text_column: str = "text") -> DataFrame:
    """`row`, `q`, base_failed, rule (the rejecting one's number) and kept, for each document.

    Null and empty texts have fewer words than needed: they fail. Repeated rows are judged
    alike, an empty table gives no rows, and the input's columns stay inside `row`.
    """
    judged = with_statistics(docs, text_column).select(
        "row", "q", base_failed().alias("base_failed"), rejecting_rule(rules).alias("rule")
    )
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return judged.select("row", "q", "base_failed", "rule", kept.alias("kept"))
