"""URL filter: rules, the models against a plain computation, held-out verdicts."""

import math
from collections import Counter

from hydroframe.llm import url_filter as U

RULES = [U.Rule("com/", True), U.Rule("a.com/en/", False), U.Rule("net/fr/", False)]


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_rules_and_odd_urls(spark):
    urls = [
        "https://X.A.COM/en/1?q#f", "http://ba.com/en/", "ftp://a.com?x=/en/", "https://a.com/EN/",
        "https://w.net/fr/", "no scheme", None, "", "x://", "https://net/fr/a://b",
    ]
    model = U.Model(rows=None, ratios=None, threshold=0.0, default=False)
    got = [tuple(r)[1:5] for r in U.judge(frame(spark, urls), RULES, model).orderBy("page_id").collect()]
    assert got == [
        ("x.a.com", "/en/1", "a.com/en/", "block"), ("ba.com", "/en/", "com/", "allow"),
        ("a.com", "", None, "block"), ("a.com", "/EN/", "com/", "allow"),
        ("w.net", "/fr/", "net/fr/", "block"), ("", "", None, "block"), ("", "", None, "block"),
        ("", "", None, "block"), ("", "", None, "block"), ("net", "/fr/a://b", "net/fr/", "block"),
    ]


def folded(url):
    rest = url.partition("://")[2] if "://" in url else url
    out = []
    for c in rest:
        low = c.lower()
        out.append(low if c.isascii() and low.isalpha() else "0" if c.isascii() and c.isdigit() else c if c in "./-" else "_")
    return out


def plain_model(urls):
    count, after = Counter(), Counter()
    for url in urls:
        chars = ["$"] * 3 + folded(url) + ["$"]
        for i in range(3, len(chars)):
            for k in range(4):
                count[tuple(chars[i - k : i]), chars[i]] += 1
    for (context, _), n in count.items():
        after[context] += n
    kinds = Counter(context for context, _ in count)

    def p(context, c):
        shorter = p(context[1:], c) if context else 1 / 32
        if not after[context]:
            return shorter
        return (count[context, c] + kinds[context] * shorter) / (after[context] + kinds[context])

    return p


def test_scores_equal_a_plain_computation(spark):
    good = [f"https://news.good{n}.org/en/{n}" for n in range(40)]
    bad = [f"http://casino-{n}.win/É?x={n}" for n in range(30)]
    rows = [(u, True) for u in good] + [(u, False) for u in bad] + [("x", None), (None, True)]
    labelled = spark.createDataFrame(rows, "url string, accepted boolean")
    model = U.train(labelled)
    held = {r.url for r in labelled.where("pmod(xxhash64(url), 5) = 0").collect()}
    a = plain_model([u or "" for u in [*good, None] if u not in held])
    r = plain_model([u for u in bad if u not in held])
    tests = [*good[:3], *bad[:3], "", "https://zzz.qq/!!", "plain", "https://x.org/" + "ab" * 2000]
    got = {tests[x.page_id]: x.score for x in U.judge(frame(spark, tests), [], model).collect()}
    for url in tests:
        chars = ["$"] * 3 + folded(url) + ["$"]
        terms = [
            math.log(a(tuple(chars[i - 3 : i]), chars[i])) - math.log(r(tuple(chars[i - 3 : i]), chars[i]))
            for i in range(3, len(chars))
        ]
        assert abs(got[url] - sum(terms) / len(terms)) < 1e-3
    judged = U.judge(frame(spark, good + bad), [], model).collect()
    held_rows = [x for x in judged if x.page_id < 70 and (good + bad)[x.page_id] in held]
    assert held_rows
    assert all((x.verdict == "allow") == (x.page_id < 40) for x in held_rows)


def test_missing_classes_and_empty_tables(spark):
    none = spark.createDataFrame([], "url string, accepted boolean")
    only_bad = spark.createDataFrame([("a", False)], "url string, accepted boolean")
    pages = frame(spark, ["https://a.org/"])
    assert U.judge(pages, [], U.train(none)).first().verdict == "allow"
    assert U.judge(pages, [], U.train(only_bad)).first().verdict == "block"
    assert U.judge(pages.limit(0), RULES, U.train(none)).collect() == []
    clash = pages.selectExpr("*", "1 as host", "2 as score", "3 as verdict", "4 as rule")
    assert len(U.judge(clash, RULES, U.train(none)).first()) == 6
