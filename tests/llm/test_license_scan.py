"""License scans: the table's notices, held-out wordings, look-alikes and odd rows."""

import random
import re
import textwrap
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hydroframe.llm import license_scan as L

SF = "/root/testdata/sf0.1"
PLANTED = {
    "GPL": r"This work is licensed under the GNU General Public License, version 3\.",
    "MIT": r"Released under the MIT License\.",
    "CC-BY-NC": r"Licensed under CC BY-NC 4\.0\.",
    "Apache": r"Licensed under the Apache License, Version 2\.0\.",
}


@pytest.fixture(scope="module")
def model(spark):
    return L.train(L.labelled_paragraphs(spark.read.parquet(f"{SF}/documents.parquet")))


def families(spark, model, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.families for r in L.scan(docs, model).orderBy("doc_id").collect()]


def test_the_tables_notices(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in L.scan(docs, model).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        plain = re.sub(r"[^\w\s.,-]|!!", "", text)
        want = sorted(f for f, p in PLANTED.items() if re.search(p, plain, re.I))
        assert got[doc].families == want, text[:300]
        assert all(0 <= f.line <= text.count("\n") for f in got[doc].findings)


def test_other_wordings_and_wrapped_text(spark, model):
    cases = {
        "MIT": ["This library is released under the MIT License, see below.",
                "to any person obtaining a copy of this software and associated documentation files, free of charge,"],
        "BSD": ["Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions"],
        "LGPL": ["modify it under the terms of the GNU Lesser General Public License as published by"],
        "Apache": ["# Licensed under the Apache License, Version 2.0 (the \"License\");"],
        "GPL": ["SOFTWARE!! IS!! LICENSED!! UNDER!! THE!! GNU!! GENERAL!! PUBLIC!! LICENSE,!! VERSION!! 3."],
        "CC-BY-SA": ["Text is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    }
    for family, texts in cases.items():
        assert families(spark, model, texts) == [[family]] * len(texts)
    long = " ".join(["filler word here"] * 60)
    assert families(spark, model, [f"{long} Released under the MIT License. {long}"]) == [["MIT"]]
    assert families(spark, model, ["Released under the MIT License.\nx\nLicensed under CC BY 4.0."]) == [["CC-BY", "MIT"]]


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width))


def test_short_names_and_wrapped_notices(spark, model):
    cases = {
        "MIT": ["MIT", "words before\n* MIT.\nand behind", wrapped(L.TEMPLATES["MIT"][3], 40)],
        "GPL": ["GPLv3", "# GPL-3.0", wrapped(L.TEMPLATES["GPL"][2], 40)],
        "Apache": ["Apache 2.0", "\tApache-2.0 "],
        "CC-BY": ["CC BY 4.0", "text\nCC BY 4.0\ntext"],
        "CC0": ["released into the public\ndomain under CC0 1.0 Universal"],
        "Proprietary": [wrapped(L.TEMPLATES["Proprietary"][0], 30)],
    }
    for family, texts in cases.items():
        assert families(spark, model, texts) == [[family]] * len(texts), family
    assert families(spark, model, ["mit", "Mit", "Er kam\nmit\nihr", "submit MIT papers", "cc by"]) == [[]] * 5


def test_scan_equals_brute_force(spark, model):
    """Every word against every triple of every template, judged one by one."""
    filler = "the house of my friend is old and public domain or free of charge by some under the terms of use".split()
    draw = random.Random(3)
    every = [t for templates in L.TEMPLATES.values() for t in templates]
    texts = []
    for _ in range(40):
        parts = [" ".join(draw.choices(filler, k=draw.randrange(20))) for _ in range(3)]
        some = [draw.choice(every) for _ in parts]
        texts.append("\n".join(x for pair in zip(parts, some) for x in pair).replace(" ", draw.choice([" ", "\n", " | "])))
    rows = []
    for doc, text in enumerate(texts):
        words = [(w.group(), text[: w.start()].count("\n")) for w in re.finditer(L.WORDS, text.lower())]
        for family, templates in L.TEMPLATES.items():
            triples = [t for template in templates for t in L._triples(L._python_words(template))]
            hit = [i for i in range(len(words)) if " ".join(w for w, _ in words[i : i + 3]) in triples]
            runs = []
            for i in hit:
                if runs and i - runs[-1][-1] <= L.APART + 3:
                    runs[-1].append(i)
                else:
                    runs.append([i])
            for run in runs:
                low, high = max(0, run[0] - L.BESIDE), run[-1] + 3 + L.BESIDE
                span = words[low:high]
                for at in [0, *range(L.STEP, max(1, len(span) - L.STEP), L.STEP)]:
                    line = words[max(run[0], low + at)][1]
                    rows.append((doc, line, family, [w for w, _ in span[at : at + L.PARAGRAPH]]))
        for line, said in enumerate(text.split("\n")):
            for family, names in L.SHORT_NAMES.items():
                if said.strip(" .,;|") in names:
                    rows.append((doc, line, family, L._python_words(said)))
    judged = L._predicted(spark.createDataFrame(rows, "doc long, line int, of string, words array<string>"), model)
    want = defaultdict(dict)
    for r in judged.collect():
        own = set(L._triples(r.words))
        shares = [0.0]
        for template in [*L.TEMPLATES.get(r.family, []), *L.SHORT_NAMES.get(r.family, [])]:
            theirs = set(L._triples(L._python_words(template)))
            shares.append(len(own & theirs) / min(len(own), len(theirs)))
        if r.family == r.of and r.probability >= model.least and max(shares) >= L.LIKENESS:
            want[r.doc][r.line, r.family] = max(want[r.doc].get((r.line, r.family), 0), r.probability)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(docs, model).collect():
        assert {(f.line, f.family): pytest.approx(f.probability) for f in r.findings} == want[r.doc_id]
    assert sum(map(len, want.values())) > 80


def test_look_alikes_are_unknown(spark, model):
    texts = [
        "He renewed the license for the bar in March.", "The copyright office is open on Mondays.",
        "No warranty was given for the used car.", "Licensed to drive trucks and buses.", "license", "free software " * 3,
        "We redistribute food to people in need, free of charge.", "", None, " \n\n", "warrant " * 5000,
    ]
    assert families(spark, model, texts) == [[]] * len(texts)


def test_odd_rows(spark, model):
    text = "Released under the MIT License."
    rows = [(None, text, "x"), (1, text, "x"), (1, text, "x"), (2, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string").withColumn("words", F.lit(1))
    got = sorted((str(r.doc_id), r.families, len(r.findings)) for r in L.scan(docs, model).collect())
    assert got == [("1", ["MIT"], 1), ("1", ["MIT"], 1), ("2", [], 0), ("None", ["MIT"], 1)]
    assert L.scan(docs.limit(0), model).collect() == []
    assert L.train(L.labelled_paragraphs(docs.limit(0))).least >= 0.5
