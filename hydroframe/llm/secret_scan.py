"""Secret scans: a random forest tells secrets from false positives.

Candidates are long runs of the characters keys are made of, and runs of any length and of
more characters where an assignment, a secret's name or `user:` stands before them. A forest, trained on labelled
findings, judges each by its length, its character transitions, how much of it dictionary
words cover, its path and its neighbouring words. The trees become one conditional
expression over the candidates of a text: scanning is one projection, without a shuffle,
a join or Python, and a task holds one row.

A text with a candidate is cut into chunks that no candidate crosses; a candidate sees the
BEFORE characters before it and the AFTER behind it. Time is in proportion to the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import aside, carried, row_of, some_texts, stored, whole_text

#: A run of 16 or more characters of keys with a digit in it, or assigned to something.
LONG = r"(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*[0-9])|(?<=[=:][\"' ]{0,2}))[A-Za-z0-9+/_-]{16,}={0,2}"
#: What passwords are made of: no white space and no quotes. And what one ends with where no quote does.
WIDE, LAST = r"[!#-&(-~\u00a1-\u024f]", r"[A-Za-z0-9!#$%&*+/=@^_~-]"
#: A digit in what is assigned. The look ahead passes SIGNS further signs at most, so that it takes time
#: in proportion to the text; where more stand before the digit, a later one begins the candidate.
SIGNS = 8
_PLAIN = r"[!#-&(-9;<>-~\u00a1-\u024f]"
DIGIT = rf"(?=(?:{_PLAIN}*+[=:]){{0,{SIGNS}}}?{_PLAIN}*[0-9])"
#: A name that a secret is assigned to, as far as it stands before the sign.
NAMED = r"(?i:passw(?:or)?d|passphrase|pass|pwd|secret|token|key|credentials?|bearer|auth)"
#: Of any length: the password of user:password@, what is assigned in quotes, what has a digit
#: and is assigned or follows a secret's name, and what is assigned to such a name.
CANDIDATE = (
    r"(?<=:)(?![/@])[!#-&(-.0-9;-~\u00a1-\u024f]+(?=@[A-Za-z0-9])"
    rf"|(?<=[=:]>? ?[\"']){WIDE}+(?=[\"'])"
    rf"|(?<=[=:]>? ?)(?![/=:>(])(?:{DIGIT}|(?<={NAMED}[A-Za-z_]{{0,8}} ?[=:]>? ?)){WIDE}*{LAST}"
    rf"|(?<= )(?<={NAMED} )(?={WIDE}*[0-9]){WIDE}*{LAST}"
    rf"|{LONG}"
)
#: A chunk ends before white space, where no candidate, and no assignment before one, can be cut.
CHUNK = rf"(?s).{{1,4096}}(?:[^ \t\n\x0B\f\r]| (?=[=:])|(?<=[=:>][\"' ]?) |(?<={NAMED}) )*+"
BEFORE, AFTER = 48, 24
MARKER = "[SECRET]"

TREES, DEPTH, SEED = 16, 6, 7
#: Documents that lend their words to planted findings.
DOCUMENTS = 2000
#: Least share a word of the dictionary has among all words: 1 / SHARE words at most.
SHARE = 1e-4

#: Words beside a candidate that speak for a secret, and for something else.
SECRET_WORDS = r"(?i)(key|token|secret|passw|pwd|credential|bearer|private|signature|auth)"
OTHER_WORDS = r"(?i)(sha|md5|checksum|digest|commit|hash|uuid|guid|revision|order|card|isbn|phone|version|build)"
#: What stands where a secret would be put in.
PLACEHOLDER = r"(?i)(your|example|sample|dummy|changeme|placeholder|insert|x{6}|0{8}|12345678)"
#: Paths of tests and documentation, and of settings.
TEST_PATH = r"(?i)(test|example|sample|fixture|mock|doc|readme)"
SETTINGS_PATH = r"(?i)(\.env|\.pem|\.cfg|\.conf|\.ini|\.ya?ml|\.properties|\.json|secret|credential)"

#: Paths of planted findings: settings, others, tests.
PATHS = ["src/settings.yml", "deploy/.env", "src/main.c", "tests/fixtures/keys.txt", "docs/readme.md"]

_SYMBOLS = 38  # a-z, 0-9, `-`, other


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or a leaf's share of secrets."""

    trees: list
    dictionary: list[str]
    #: Mean log-likelihood of each pair of symbols in words.
    pairs: list[float]
    threshold: float = 0.5


def _zip3(a: Column, b: Column, c: Column, names: tuple[str, str, str]) -> Column:
    both = F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.zip_with(
        both, c, lambda p, z: F.struct(p["x"].alias(names[0]), p["y"].alias(names[1]), z.alias(names[2]))
    )


def _chunks(text: Column) -> Column:
    """start, text, before, after of each chunk; none where the text has no candidate."""
    return F.when(text.rlike(CANDIDATE), F.regexp_extract_all(text, F.lit(CHUNK), 0)).otherwise(
        F.array().cast("array<string>")
    )


def _placed(chunks: Column) -> Column:
    tails = F.transform(chunks, lambda c: F.right(c, F.lit(BEFORE)))
    heads = F.transform(chunks, lambda c: F.left(c, F.lit(AFTER)))
    earlier = F.concat(F.array(F.lit("")), F.slice(tails, 1, F.greatest(F.size(tails) - 1, F.lit(0))))
    later = F.concat(F.slice(heads, 2, F.greatest(F.size(heads) - 1, F.lit(0))), F.array(F.lit("")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    starts = F.aggregate(
        chunks,
        start,
        lambda s, c: F.struct(
            (s["at"] + F.length(c)).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")
        ),
        lambda s: s["starts"],
    )
    texts = F.zip_with(chunks, starts, lambda c, s: F.struct(c.alias("text"), s.alias("start")))
    made = _zip3(texts, earlier, later, ("own", "before", "after"))
    # With no chunk the two lists of neighbours still have one empty entry.
    return F.filter(made, lambda c: c["own"].isNotNull())


_PIECE = "struct<gap:string,token:string,start:int,before:string,after:string>"


def _pieces(chunk: Column) -> Column:
    """The chunk as what lies before each candidate, the candidate, and its surroundings."""
    text = chunk["own"]["text"]
    gaps = F.split(text, CANDIDATE)
    tokens = F.regexp_extract_all(text, F.lit(CANDIDATE), 0)
    behind = F.concat(F.slice(gaps, 2, F.size(gaps)), F.array(F.lit("")))
    state = F.struct(
        chunk["own"]["start"].alias("at"),
        chunk["before"].alias("tail"),
        F.array().cast(f"array<{_PIECE}>").alias("found"),
    )

    def step(s: Column, p: Column) -> Column:
        before = F.right(F.concat(s["tail"], p["gap"]), F.lit(BEFORE))
        start = s["at"] + F.length(p["gap"])
        piece = F.struct(
            p["gap"].alias("gap"),
            p["token"].alias("token"),
            start.alias("start"),
            before.alias("before"),
            F.left(F.concat(p["behind"], chunk["after"]), F.lit(AFTER)).alias("after"),
        )
        token = F.coalesce(p["token"], F.lit(""))
        return F.struct(
            (start + F.length(token)).alias("at"),
            F.right(F.concat(before, token), F.lit(BEFORE)).alias("tail"),
            F.concat(s["found"], F.array(piece)).alias("found"),
        )

    return F.aggregate(_zip3(gaps, tokens, behind, ("gap", "token", "behind")), state, step, lambda s: s["found"])


def _folded(token: Column) -> Column:
    """Letters, digits and `-`, else `~`, as characters of consecutive codes from 65."""
    low = F.regexp_replace(F.lower(token), "[^a-z0-9-]", "~")
    return F.translate(low, "abcdefghijklmnopqrstuvwxyz0123456789-~", "".join(chr(65 + i) for i in range(_SYMBOLS)))


def _likelihood(token: Column, pairs: list[float]) -> Column:
    """Mean log-likelihood of the token's symbol pairs."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in pairs)), ",").cast("array<double>")
    chars = F.filter(F.split(_folded(token), ""), lambda c: c != "")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        code = F.ascii(c) - 65
        worth = F.when(s["last"] < 0, 0.0).otherwise(F.get(table, s["last"] * _SYMBOLS + code))
        return F.struct(code.alias("last"), (s["total"] + worth).alias("total"), (s["n"] + 1).alias("n"))

    return F.aggregate(chars, start, step, lambda s: s["total"] / F.greatest(s["n"] - 1, F.lit(1)))


def _share(token: Column, of: str) -> Column:
    return F.regexp_count(token, F.lit(of)) / F.length(token)


def _features(model_pairs: list[float], dictionary: list[str]) -> dict[str, Callable[[Column, Column], Column]]:
    """Each feature of a candidate `p` in the path `path`, as a number."""
    words = _any_of(dictionary)
    change = "(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": lambda p, path: F.length(p["token"]).cast("double"),
        "lower": lambda p, path: _share(p["token"], "[a-z]"),
        "at_sign": lambda p, path: flag(p["before"].rlike(":$") & p["after"].startswith("@")),
        "account": lambda p, path: flag(p["before"].rlike("://[^\\s:/@]*:$")),
        "digits": lambda p, path: _share(p["token"], "[0-9]"),
        "upper": lambda p, path: _share(p["token"], "[A-Z]"),
        "signs": lambda p, path: _share(p["token"], "[^A-Za-z0-9]"),
        "changes": lambda p, path: _share(p["token"], change),
        "likelihood": lambda p, path: _likelihood(p["token"], model_pairs),
        "covered": lambda p, path: (
            1 - F.length(F.regexp_replace(F.lower(p["token"]), words, "")) / F.length(p["token"])
        ),
        "kinds": lambda p, path: F.size(F.array_distinct(F.split(p["token"], ""))) / F.least(F.length(p["token"]), F.lit(36)),
        "hex": lambda p, path: flag(p["token"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "uuid": lambda p, path: flag(p["token"].rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")),
        "placeholder": lambda p, path: flag(p["token"].rlike(PLACEHOLDER)),
        "assigned": lambda p, path: flag(p["before"].rlike("[=:]\\s*[\"']?$")),
        "quoted": lambda p, path: flag(p["before"].rlike("[\"']$") & p["after"].rlike("^[\"']")),
        "secret_word": lambda p, path: flag(F.right(p["before"], F.lit(24)).rlike(SECRET_WORDS)),
        "password_word": lambda p, path: flag(F.right(p["before"], F.lit(16)).rlike("(?i)(passw|pwd|passphrase)")),
        "other_word": lambda p, path: flag(F.right(p["before"], F.lit(24)).rlike(OTHER_WORDS)),
        "address": lambda p, path: flag(p["before"].rlike("(://\\S*|[./\\\\@])$") | p["after"].rlike("^[@./\\\\]\\w")),
        "test_path": lambda p, path: flag(path.rlike(TEST_PATH)),
        "settings_path": lambda p, path: flag(path.rlike(SETTINGS_PATH)),
    }


def _once(name: str, value: Column) -> Column:
    """A generator of one row: what is built on the value does not work it out again."""
    return F.explode(F.array(value)).alias(name)


def _candidates(docs: DataFrame, text_column: str, path_column: str | None) -> DataFrame:
    """The carried columns, `path` and `chunks`: the pieces of each chunk."""
    path = F.lit("") if path_column is None else F.coalesce(F.col(path_column).cast("string"), F.lit(""))
    own = carried(docs)
    texts = docs.select(*aside(docs), path.alias("path"), whole_text(F.col(text_column)).alias("text"))
    cut = texts.select(*own, "path", _once("cut", _chunks(F.col("text"))))
    placed = cut.select(*own, "path", _once("placed", _placed(F.col("cut"))))
    return placed.select(*own, "path", _once("chunks", F.transform("placed", _pieces)))


def _tree(node) -> tuple | float:
    """A tree of the fitted forest, from the JVM's nodes."""
    if node.getClass().getSimpleName() == "LeafNode":
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats) if sum(stats) else 0.0
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def _worth(tree: tuple | float, features: Column, names: list[str]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    index, threshold, left, right = tree
    below = features[names[index]] <= threshold
    return F.when(below, _worth(left, features, names)).otherwise(_worth(right, features, names))


def _words_of(docs: DataFrame, text_column: str) -> tuple[list[str], list[float]]:
    """The words that are frequent in all documents, and the likelihood of symbol pairs.

    One aggregation with partial counts; its table is as long as there are different words."""
    found = F.regexp_extract_all(F.lower(whole_text(F.col(text_column))), F.lit("[a-z]{2,24}"), 0)
    counted = stored(docs.select(F.explode(found).alias("word")).groupBy("word").count(), "words")
    long = counted.where("length(word) >= 4")
    total = long.agg(F.sum("count")).first()[0] or 0
    common = long.where(F.col("count") >= total * SHARE).select("word").collect()
    pair = F.explode(F.regexp_extract_all(_folded(F.col("word")), F.lit("(?=(..))."), 1))
    pairs = counted.select(pair.alias("pair"), "count").groupBy("pair").agg(F.sum("count").alias("n")).collect()
    n = [[0.5] * _SYMBOLS for _ in range(_SYMBOLS)]
    for r in pairs:  # at most 38 x 38
        n[ord(r.pair[0]) - 65][ord(r.pair[1]) - 65] += r.n
    return sorted(r.word for r in common), [math.log(x / sum(row)) for row in n for x in row]


def _any_of(words: list[str]) -> str:
    """A pattern of the longest word that fits, as a tree of prefixes."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [re.escape(letter) + pattern(node[letter]) for letter in sorted(node) if letter]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)}){'?' if '' in node else ''}"

    return pattern(tree) or "(?!)"


def train(labelled: DataFrame, docs: DataFrame, text_column: str = "text") -> Model:
    """The forest of labelled findings (text, path, secret boolean; each text holds the finding
    and its surroundings). All of `docs` give the dictionary and the likelihoods of character
    pairs. Texts without a candidate, and null labels, are left out.
    With findings of one label only, everything gets that label; with none, nothing is a secret.
    """
    dictionary, pairs = _words_of(docs, text_column)
    features = _features(pairs, dictionary)
    names = list(features)
    known = labelled.where("secret is not null").select("text", "path", F.col("secret").cast("double").alias("label"))
    pieces = _candidates(known, "text", "path").select(
        "path", F.col("__in_2").alias("label"), F.explode(F.flatten("chunks")).alias("p")
    )
    rows = pieces.where("p.token is not null").select(
        "label", *(features[name](F.col("p"), F.col("path")).alias(name) for name in names)
    )
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features").cache()
    labels = [r.label for r in rows.select("label").distinct().collect()]
    if len(labels) < 2:
        rows.unpersist()
        return Model([max(labels, default=0.0)], dictionary, pairs)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, subsamplingRate=0.8).fit(rows)
    rows.unpersist()
    return Model([_tree(tree._java_obj.rootNode()) for tree in forest.trees], dictionary, pairs)


def scan(
    docs: DataFrame, model: Model, text_column: str = "text", path_column: str | None = None
) -> DataFrame:
    """`row`, `findings` (start from 0, length, score of each secret, in order) and `redacted`,
    the text with a marker in place of each.

    Null and empty texts have no findings; a null text stays null. Repeated rows have equal
    findings; an empty table gives no rows; the input's columns stay inside `row`.
    """
    features = _features(model.pairs, model.dictionary)
    names = list(features)
    known = _candidates(docs, text_column, path_column)
    path = F.col("path")

    def described(p: Column) -> Column:
        made = F.struct(*(features[name](p, path).alias(name) for name in names))
        return F.struct(p.alias("p"), F.when(p["token"].isNotNull(), made).alias("x"))

    def judged(d: Column) -> Column:
        total = _worth(model.trees[0], d["x"], names)
        for tree in model.trees[1:]:
            total = total + _worth(tree, d["x"], names)
        score = F.when(d["x"].isNotNull(), total / len(model.trees))
        return F.struct(d["p"].alias("p"), F.coalesce(score, F.lit(0.0)).alias("score"))

    own = carried(docs)
    flat = known.select(*own, "path", _once("pieces", F.flatten("chunks")))
    seen = flat.select(*own, _once("d", F.transform("pieces", described)))
    scored = seen.select(*own, _once("s", F.transform("d", judged)))
    secrets = F.filter("s", lambda s: s["score"] >= model.threshold)
    findings = F.transform(
        secrets,
        lambda s: F.struct(
            s["p"]["start"].alias("start"), F.length(s["p"]["token"]).alias("length"), s["score"].alias("score")
        ),
    )
    parts = F.transform(
        "s",
        lambda s: F.concat(
            s["p"]["gap"],
            F.when(s["score"] >= model.threshold, F.lit(MARKER)).otherwise(F.coalesce(s["p"]["token"], F.lit(""))),
        ),
    )
    found = scored.select(*own, _once("findings", findings), parts.alias("parts"))
    text = F.col(own[docs.columns.index(text_column)])
    redacted = F.when(F.size("findings") > 0, F.array_join("parts", "")).otherwise(text)
    return found.select(row_of(docs), "findings", redacted.alias("redacted"))


def planted_findings(docs: DataFrame, text_column: str = "text", most: int = DOCUMENTS) -> DataFrame:
    """Labelled findings for training: made-up secrets and look-alikes between words of up to
    `most` documents. Text, path, secret.

    Half of the secrets stand in settings and few in tests, as it is in repositories; of the
    look-alikes it is the other way round. Other paths tell nothing.
    """
    sample = some_texts(docs, whole_text(F.col(text_column)), most)
    word = lambda n: F.coalesce(F.get("w", F.lit(n)), F.lit("word"))
    digest = F.sha2("text", 512)
    hexes = lambda n: F.substring(digest, 1, n)
    coded = F.translate(F.base64(F.unhex(digest)), "\r\n", "")
    number = F.translate(digest, "abcdef", "")
    plain = lambda n: F.regexp_replace(F.lower(word(n)), "[^a-z]", "")
    name = F.concat_ws("-", plain(3), plain(4), plain(5), plain(6))
    uuid = F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    signed = lambda at, n: F.translate(F.substring(coded, at, n), "aeiostAEIOST", "@3!0$7&%*.#^")
    mixed = F.concat(F.initcap(plain(3)), F.lit("$"), F.substring(number, 1, 3), F.lit("!"))
    weak = F.concat(plain(4), F.substring(number, 2, 2), plain(5))
    quoted = lambda key, value: F.concat(F.lit(key + ' = "'), value, F.lit('"'))
    after = lambda key, value: F.concat(F.lit(key), value)
    secrets = [
        quoted("token", hexes(40)), quoted("TOKEN", F.upper(hexes(40))), after("api_key: ", F.substring(coded, 1, 40)),
        after("SECRET=", hexes(64)), quoted("password", F.substring(coded, 3, 20)), quoted("key", hexes(32)),
        after("aws AKIA", F.upper(F.substring(digest, 1, 16))), after("Authorization: Bearer ", F.substring(coded, 1, 48)),
        after("ghp_", F.regexp_replace(F.substring(coded, 1, 36), "[+/=]", "x")), quoted("client_secret", coded),
        quoted("password", signed(1, 12)), after("PWD=", weak), after("password: ", mixed), quoted("passwd", mixed),
        F.concat(F.lit("postgres://user:"), F.substring(coded, 5, 9), F.lit("@host/db")), after("DB_PASSWORD=", signed(7, 10)),
        F.concat(F.lit("https://admin:"), weak, F.lit("@www.example.com")), quoted("secret", F.substring(coded, 2, 10)),
        F.concat(F.lit("mysql://root:"), mixed, F.lit("@db.local:3306")), after("passwd = ", weak), quoted("pwd", weak),
        after("password ", mixed), after("PASSWORD=", F.substring(coded, 9, 8)), quoted("db_password", mixed),
        after("pwd: ", F.concat(plain(5), F.substring(number, 1, 3))), after("MYSQL_PWD=", F.concat(plain(6), F.substring(number, 3, 1), plain(3))),
    ]
    others = [
        after("commit ", hexes(40)), after("sha256:", hexes(64)), after("id ", uuid), F.substring(number, 1, 16),
        after("md5 checksum ", hexes(32)), after("/usr/lib/", F.concat(name, F.lit("-2.1"))), quoted("uuid", uuid),
        after("https://www.example.com/", F.concat(name, F.lit("/2021"))), quoted("token", F.lit("your_token_here_1")),
        quoted("api_key", F.lit("xxxxxxxxxxxxxxxx1")), quoted("key", F.concat(plain(3), plain(4), plain(5), F.lit("2"))),
        after("order ", F.substring(number, 3, 18)), F.concat(plain(7), plain(8), plain(9), plain(10), F.lit("1")),
        quoted("name", F.concat(name, F.lit("-config-name-value"))), after("version ", F.concat(F.lit("2021-01-02-"), F.substring(number, 1, 8))),
        after("page: ", F.substring(number, 1, 2)), after("time 12:", F.substring(number, 1, 2)), after("key: ", plain(3)),
        after("port = ", F.substring(number, 1, 4)), quoted("class", plain(3)), quoted("href", F.concat(plain(3), F.lit(".html"))),
        after("password: ", plain(3)), after("The token: ", plain(4)), after("key ", F.substring(number, 1, 2)),
        F.concat(F.lit("mailto:"), plain(3), F.lit("@example.com")), quoted("password", F.lit("********")),
        after("http://localhost:", F.concat(F.substring(number, 1, 4), F.lit("/"), plain(3))), quoted("name", plain(4)),
        quoted("id", F.concat(plain(3), F.lit("-"), F.substring(number, 1, 2))), after("date: 2021-01-", F.substring(number, 1, 2)),
        after("price: $", F.substring(number, 1, 3)), after("password: ", F.lit("${PASSWORD1}")), quoted("password", F.lit("changeme")),
        quoted("color", F.concat(F.lit("#"), hexes(6))), quoted("width", F.concat(F.substring(number, 1, 2), F.lit("%"))),
        F.concat(F.lit("at 12:"), F.substring(number, 1, 2), F.lit("@"), plain(3)), F.concat(F.lit("at 9:"), F.substring(number, 3, 2), F.lit("@www.example.com")),
        after("score: ", F.concat(F.substring(number, 1, 1), F.lit("-"), F.substring(number, 2, 1))), after("v=", hexes(8)),
    ]
    cases = F.array(
        *(F.struct(x.alias("x"), F.lit(True).alias("secret")) for x in secrets),
        *(F.struct(x.alias("x"), F.lit(False).alias("secret")) for x in others),
    )
    words = F.split(F.col("text"), " ", 16)
    near = lambda a, b: F.concat_ws(" ", word(a), word(b))
    return (
        sample.select("text", words.alias("w"))
        .select(near(0, 1).alias("a"), near(2, 3).alias("b"), F.posexplode(cases).alias("n", "case"), "text")
        .where(F.pmod(F.xxhash64("text", "n"), F.lit(4)) == 0)
        .withColumn("drawn", F.pmod(F.xxhash64("n", "text"), F.lit(20)))
        .select(
            F.concat_ws(" ", "a", "case.x", "b").alias("text"),
            F.get(F.array(*map(F.lit, PATHS)), F.when(F.col("drawn") < F.when(F.col("case.secret"), 9).otherwise(3), F.pmod("drawn", F.lit(2)))
                  .when(F.col("drawn") < F.when(F.col("case.secret"), 18).otherwise(12), 2)
                  .otherwise(F.pmod("drawn", F.lit(2)) + 3).cast("int")).alias("path"),
            "case.secret",
        )
    )
