"""URL filter by the ratio of two character language models, one of accepted, one of rejected URLs.

Each model is a variable-order Markov model: a character is predicted from the longest
context of up to three characters seen in training, smoothed with the shorter ones
(Witten-Bell). A URL's score is the mean, over its characters, of the difference of the
two log-likelihoods; the threshold is calibrated on URLs kept out of the training.

Characters are folded to 32 symbols, so a model has at most 32^4 counts for each class
(about a million), however many URLs it is trained on: that is the bound of what the
driver gets and of the table the scoring expression carries. The counts are gathered
from all labelled URLs by one aggregation, and scoring is one expression over each URL:
no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbols: 26 letters, digits, `.`, `/`, `-`, any other, the URL's border.
SYMBOLS = 32
BORDER = chr(65 + 31)
ORDER = 3
_FROM = "abcdefghijklmnopqrstuvwxyz0123456789./-"
_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "[" * 10 + "\\]^"

#: One of so many labelled URLs calibrates the threshold instead of training the models.
HELD_OUT = 5


@dataclass(frozen=True)
class Rule:
    """`host/path...`: fits the host and its subdomains where the URL's path starts with the rule's."""

    text: str
    allow: bool

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


@dataclass(frozen=True)
class Model:
    """`rows[context]` is the row of `ratios` that holds the 32 log-likelihood differences."""

    rows: np.ndarray
    ratios: np.ndarray
    threshold: float
    #: What to say where a class had no examples, so that there is nothing to compare.
    default: bool | None = None


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null and for a text without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """Text of the longest rule that fits, else null; of equal length, the longer host first."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.text)).otherwise(found)
    return found


def symbols(url: Column) -> Column:
    """The URL behind its scheme, each character folded to one symbol, codes 65 to 95."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(url)
    plain = F.regexp_replace(F.coalesce(rest, F.lit("")), "[^A-Za-z0-9./-]", "_")
    return F.translate(plain, _FROM, _TO)


def _grams(labelled: DataFrame) -> DataFrame:
    padded = F.concat(F.lit(BORDER * ORDER), symbols(F.col("url")), F.lit(BORDER))
    return labelled.select(
        F.col("accepted"),
        F.explode(F.regexp_extract_all(padded, F.lit(f"(?=(.{{{ORDER + 1}}}))"), 1)).alias("gram"),
    )


def _smoothed(counts: np.ndarray) -> list[np.ndarray]:
    """P(symbol | context) for contexts of 0 to ORDER symbols, from counts of ORDER + 1 symbols."""
    found, lower = [], np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(ORDER + 1):
        n = counts.reshape(-1, SYMBOLS**order, SYMBOLS).sum(axis=0)
        total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
        back = np.tile(lower.reshape(-1, SYMBOLS), (max(1, len(n) // max(1, lower.size // SYMBOLS)), 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            p = (n + kinds * back) / (total + kinds)
        lower = np.where(total > 0, p, back)
        found.append(lower)
    return found


def _tables(counts: dict[bool, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row of ratios for each context seen; other contexts point to their longest seen ending."""
    ratios = [np.log(a) - np.log(r) for a, r in zip(_smoothed(counts[True]), _smoothed(counts[False]))]
    both = counts[True] + counts[False]
    table, pointer = [ratios[0]], np.zeros(1, dtype=np.int64)
    n_rows = 1
    for order in range(1, ORDER + 1):
        seen = both.reshape(-1, SYMBOLS**order, SYMBOLS).sum(axis=(0, 2)) > 0
        pointer = np.tile(pointer, SYMBOLS)  # the context without its oldest symbol
        pointer[seen] = n_rows + np.arange(seen.sum())
        table.append(ratios[order][seen])
        n_rows += int(seen.sum())
    return pointer, np.concatenate(table)


def _numbers(values: Iterable, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def score(url: Column, model: Model) -> Column:
    """Mean log-likelihood difference of a character, the closing border included."""
    rows = _numbers((model.rows * SYMBOLS).tolist(), "int")
    ratios = _numbers([f"{x:.4f}" for x in model.ratios.ravel()], "double")
    chars = F.filter(F.split(F.concat(symbols(url), F.lit(BORDER)), ""), lambda c: c != "")
    start = F.struct(
        F.lit(SYMBOLS**ORDER - 1).alias("context"), F.lit(0.0).alias("total"), F.lit(0).alias("n")
    )

    def step(state: Column, char: Column) -> Column:
        code = F.ascii(char) - 65
        return F.struct(
            (state["context"] * SYMBOLS + code).bitwiseAND(SYMBOLS**ORDER - 1).alias("context"),
            (state["total"] + F.get(ratios, F.get(rows, state["context"]) + code)).alias("total"),
            (state["n"] + 1).alias("n"),
        )

    return F.aggregate(chars, start, step, lambda s: s["total"] / s["n"])


def train(labelled: DataFrame) -> Model:
    """Models of all labelled URLs and their threshold. `labelled`: url string, accepted boolean.

    URLs of one hash in five calibrate the threshold, the others are counted. The threshold
    is the middle of the scores (in hundredths) with the best mean of both classes' shares
    told right. Rows without a class are left out; a null URL is an empty one. If a class
    has no example, nothing is compared: everything gets the class that has some, or is
    allowed where neither has.
    """
    labelled = labelled.select("url", "accepted").where("accepted is not null")
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    counted = _grams(labelled.where(~held)).groupBy("accepted", "gram").count().collect()
    counts = {kind: np.zeros(SYMBOLS ** (ORDER + 1)) for kind in (True, False)}
    for accepted, gram, n in counted:
        code = 0
        for c in gram:
            code = code * SYMBOLS + ord(c) - 65
        counts[accepted][code] += n
    if not counts[True].any() or not counts[False].any():
        default = bool(counts[True].any()) or not counts[False].any()
        return Model(np.zeros(1, dtype=np.int64), np.zeros((1, SYMBOLS)), 0.0, default)
    model = Model(*_tables(counts), 0.0)
    bins = F.round(F.greatest(F.least(score(F.col("url"), model) * 100, F.lit(1000)), F.lit(-1000)))
    tested = labelled.where(held).groupBy("accepted", bins.cast("int").alias("bin")).count().collect()
    return Model(model.rows, model.ratios, _threshold(tested))


def _threshold(tested: list) -> float:
    """From (accepted, score in hundredths, count); 0 where a class is missing."""
    told = {kind: np.zeros(2001) for kind in (True, False)}
    for accepted, at, n in tested:
        told[accepted][at + 1000] += n
    if not told[True].any() or not told[False].any():
        return 0.0
    above = told[True][::-1].cumsum()[::-1] / told[True].sum()
    below = np.concatenate([[0], told[False].cumsum()[:-1]]) / told[False].sum()
    right = above + below
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[len(best) // 2] - 1000 - 0.5) / 100)


def judge(
    pages: DataFrame,
    rules: Iterable[Rule],
    model: Model,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """Each page's id, host, path, rule, verdict and score.

    The verdict is the rule's, else the method's: allow where the score reaches the
    threshold. A null URL, or one without `://`, has no host and no path; the method
    judges its whole text, a null as the empty text. Repeated rows are judged each, an
    empty table gives no rows, other columns are ignored.
    """
    rules = list(rules)
    url = F.col(url_column)
    host, path = host_and_path(url)
    judged = pages.select(
        F.col(id_column),
        host.alias("host"),
        path.alias("path"),
        (F.lit(None).cast("double") if model.default is not None else score(url, model)).alias("score"),
    ).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    allowed = [r.text for r in rules if r.allow]
    by_method = F.lit(model.default) if model.default is not None else F.col("score") >= model.threshold
    allow = F.when(F.col("rule").isNotNull(), F.col("rule").isin(allowed)).otherwise(by_method)
    verdict = F.when(allow, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select(id_column, "host", "path", "rule", verdict.alias("verdict"), "score")


def labelled_by_rules(pages: DataFrame, rules: Iterable[Rule], url_column: str = "url") -> DataFrame:
    """Training rows: the URLs that a rule fits, with the rule's verdict."""
    rules = list(rules)
    host, path = host_and_path(F.col(url_column))
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    return (
        pages.select(F.col(url_column).alias("url"), host.alias("host"), path.alias("path"))
        .select("url", rule.alias("rule"))
        .where("rule is not null")
        .select("url", F.col("rule").isin([r.text for r in rules if r.allow]).alias("accepted"))
    )
