"""License scans: a paragraph classifier names the licence family, templates confirm it.

A family is reported where the classifier says so and a template of the family confirms it, by
sharing enough of its word triples with the paragraph. So a paragraph that shares none cannot be
reported, and only words around shared triples are ever classified: for each family, what
stands between its triples that lie close together, with a few words on both sides, over
line ends, since notices are wrapped; of long ones, overlapping runs. A line that consists
of a family's short name, written as it is, is a paragraph, too.

Paragraphs are classified by logistic regression on hashed word n-grams, among the families
and an unknown class that other paragraphs of the corpus train. The least probability for a
family is calibrated on paragraphs kept out of the training.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.llm.common import small_batches, some_texts, stored, whole_text

UNKNOWN = "unknown"
#: Words of licences: lines without them train the unknown class.
CUE = (
    r"(?i)licen[sc]|copyright|copyleft|warrant|redistribut|spdx|public domain|rights reserved"
    r"|free of charge|creative commons|free software"
)
WORDS = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
#: Words of a paragraph, and the step of the runs of a longer one.
PARAGRAPH, STEP = 60, 30
#: Words between triples of one paragraph at most, and words taken on both sides.
APART, BESIDE = 8, 2
#: Characters of a line that may be a short name.
SHORT_LINE = 40
#: Hashed features of each n-gram length; share of a template's or paragraph's triples that confirms.
FEATURES, LIKENESS = 1 << 12, 0.5
#: At most so many paragraphs of the corpus train the unknown class.
PARAGRAPHS = 1500
#: Share of unknown paragraphs that calibration lets pass as a family.
LET_PASS = 0.002

# Notices as licences word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU GPL version 2 license.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0": [
        "Released into the public domain under CC0 1.0 Universal, no rights reserved.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense license.",
    ],
    "Proprietary": [
        "All rights reserved. This software is proprietary and confidential; unauthorized copying is strictly prohibited.",
        "This software may be used only under a commercial license agreement.",
    ],
}
# What the families are called for short, as it is written.
SHORT_NAMES = {
    "MIT": ["MIT", "MIT License"],
    "Apache": ["Apache 2.0", "Apache-2.0", "Apache License 2.0", "ASL 2.0"],
    "GPL": ["GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GPL 2.0", "GPL 3.0", "GNU GPL", "GNU GPLv3"],
    "LGPL": ["LGPL", "LGPLv2.1", "LGPLv3", "LGPL-2.1", "LGPL-3.0", "GNU LGPL"],
    "AGPL": ["AGPL", "AGPLv3", "AGPL-3.0", "GNU AGPL"],
    "BSD": ["BSD", "BSD License", "BSD 2-Clause", "BSD 3-Clause", "BSD-2-Clause", "BSD-3-Clause"],
    "MPL": ["MPL", "MPL 2.0", "MPL-2.0"],
    "CC-BY": ["CC BY", "CC-BY", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0"],
    "CC-BY-SA": ["CC BY-SA", "CC-BY-SA", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "CC-BY-NC": ["CC BY-NC", "CC-BY-NC", "CC BY-NC 4.0", "CC-BY-NC-4.0"],
    "CC0": ["CC0", "CC0 1.0", "CC0-1.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
}
# Sentences with the same words that are no licence notice.
OTHERS = [
    "The driver showed his license to the officer.",
    "Her license plate was stolen last night.",
    "The poet takes some artistic license with the story.",
    "A fishing license costs ten dollars for the season.",
    "The warranty covers two years and all parts.",
    "Copyright law has changed over the last century.",
    "Police had a warrant to search the house.",
    "The doctor lost his medical license after the trial.",
    "Breakfast is free of charge for all guests.",
    "The old records are in the public domain by now.",
    "They sold the patents and the brand license to a company.",
    "Our licensing team will answer your questions by phone.",
    "The general public was invited to the license office.",
    "Taxes redistribute income among citizens.",
]


@dataclass(frozen=True)
class Model:
    classes: list[str]
    fitted: PipelineModel
    least: float


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), 0)


def _python_words(text: str) -> list[str]:
    return re.findall(WORDS, text.lower())


def _triples(words: list[str]) -> list[str]:
    if len(words) < 3:
        return [" ".join(words)] if words else []
    return sorted({" ".join(words[i : i + 3]) for i in range(len(words) - 2)})


@lru_cache(maxsize=None)
def _known() -> tuple[dict[tuple[str, ...], list[str]], dict[str, str]]:
    """Families of each triple of the templates, and the family of each short name."""
    triples: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for family, templates in TEMPLATES.items():
        for triple in sorted({t for template in templates for t in _triples(_python_words(template))}):
            triples[tuple(triple.split(" "))].append(family)
    return dict(triples), {name: family for family, names in SHORT_NAMES.items() for name in names}


def paragraphs_of(text: str) -> list[tuple[int, str, list[str]]]:
    """(line, family, words) of each paragraph that a family's template may confirm."""
    triples, short = _known()
    lower = text.lower()
    words = re.findall(WORDS, lower)
    hits: dict[str, list[int]] = defaultdict(list)
    for at, triple in enumerate(zip(words, words[1:], words[2:])):
        if triple in triples:
            for family in triples[triple]:
                hits[family].append(at)
    found = []
    if hits:
        lines, line, last = [], 0, 0
        for word in re.finditer(WORDS, lower):
            line += lower.count("\n", last, word.start())
            last = word.start()
            lines.append(line)
        for family, places in hits.items():
            start = 0
            for n, at in enumerate(places):
                if n + 1 < len(places) and places[n + 1] - at <= APART + 3:
                    continue
                first, behind = max(0, places[start] - BESIDE), at + 3 + BESIDE
                run = words[first:behind]
                for step in range(0, max(1, len(run) - PARAGRAPH + STEP), STEP):
                    found.append((lines[max(places[start], first + step)], family, run[step : step + PARAGRAPH]))
                start = n + 1
    for line, said in enumerate(text.split("\n")):
        if 2 < len(said) < SHORT_LINE and (name := said.strip(" \t\r.,;:!*#/-_()[]\"'|>")) in short:
            found.append((line, short[name], _python_words(name)))
    return found


_FOUND = pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("words", pa.list_(pa.string()))]))


def paragraphs(named: DataFrame) -> DataFrame:
    """`id`, `th` and `found`, the `paragraphs_of` each text, of (id, th, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"line": line, "family": family, "words": words} for line, family, words in paragraphs_of(text)]
                for text in batch.column(2).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, _FOUND)], ["id", "th", "found"]
            )

    kind = named.schema["id"].dataType.simpleString()
    return small_batches(named).mapInArrow(
        run, f"id {kind}, th binary, found array<struct<line: int, family: string, words: array<string>>>"
    )


def _features() -> list:
    stages, inputs = [], ["words"]
    for n in (2, 3):
        stages.append(NGram(n=n, inputCol="words", outputCol=f"words{n}"))
        inputs.append(f"words{n}")
    for name in inputs:
        stages.append(HashingTF(inputCol=name, outputCol=f"tf_{name}", numFeatures=FEATURES, binary=True))
    return [*stages, VectorAssembler(inputCols=[f"tf_{name}" for name in inputs], outputCol="features")]


def labelled_paragraphs(docs: DataFrame, text_column: str = "text", most: int = PARAGRAPHS) -> DataFrame:
    """`words`, `family`: templates, whole, in parts and among words of the corpus; and
    paragraphs of the corpus, alone and among licence words, as unknown. Up to `most` lines
    of up to `most` documents are used."""
    spark = docs.sparkSession
    sample = some_texts(docs, whole_text(F.col(text_column)), most)
    lines = sample.select(F.explode(F.split("text", "\n")).alias("l")).where(~F.col("l").rlike(CUE))
    plain = lines.select("l", F.slice(words_of(F.col("l")), 1, PARAGRAPH).alias("words")).where("size(words) > 2")
    plain = plain.distinct().orderBy(F.xxhash64("l"), "l").limit(most).select("words")
    known = [r.words for r in plain.collect()] or [["no", "text", "here"]]
    rows: list[tuple] = [(words, UNKNOWN) for words in known]
    n = 0

    def beside() -> tuple[list[str], list[str]]:
        nonlocal n
        n += 1
        words = known[n * 7919 % len(known)]
        return words[: n % 9], words[:: -1][: n * 5 % 7]

    for family, templates in TEMPLATES.items():
        for template in templates:
            words = _python_words(template)
            rows += [(words, family)] * 4
            for _ in range(8):
                before, after = beside()
                rows.append((before + words + after, family))
            for at in range(0, max(0, len(words) - 10), 5):
                rows += [(words[at : at + 14], family)] * 2
    for family, names in SHORT_NAMES.items():
        rows += [(_python_words(name), family) for name in names] * 4
    for sentence in OTHERS:
        words = _python_words(sentence)
        for _ in range(8):
            before, after = beside()
            rows.append((before + words + after, UNKNOWN))
    cues = ["license", "copyright", "warranty", "licence", "public", "version", "free", "domain", "under", "licensed"]
    for at, words in enumerate(known):
        rows.append((words[: at % 12] + [cues[at % len(cues)]] + words[at % 12 : 30], UNKNOWN))
    return spark.createDataFrame(rows, "words array<string>, family string")


def train(labelled: DataFrame) -> Model:
    """The classifier of `labelled` (words, family), and the least probability for a family,
    calibrated on one paragraph in four that is kept out: at most LET_PASS of the unknown ones
    reach it. The rows are few and bounded by who made them."""
    held = F.pmod(F.xxhash64(F.concat_ws(" ", "words")), F.lit(4)) == 0
    classes = sorted(r.family for r in labelled.select("family").distinct().collect())
    number = F.array_position(F.array(*map(F.lit, classes)), F.col("family")) - 1
    # Few rows: more partitions would only send more copies of the coefficients around.
    rows = labelled.select("words", number.cast("double").alias("label"), held.alias("held")).coalesce(1).cache()
    learner = LogisticRegression(family="multinomial", regParam=0.001, maxIter=60)
    fitted = Pipeline(stages=[*_features(), learner]).fit(rows.where("not held"))
    model = Model(classes, fitted, 0.0)
    tested = _predicted(rows.where("held"), model).where(F.col("family") != UNKNOWN)
    unknown = float(classes.index(UNKNOWN)) if UNKNOWN in classes else -1.0
    wrong = sorted((r.probability for r in tested.where(F.col("label") == unknown).collect()), reverse=True)
    n = rows.where(held & (F.col("label") == unknown)).count()
    rows.unpersist()
    allowed = int(LET_PASS * n)
    least = wrong[allowed] + 1e-9 if len(wrong) > allowed else 0.0
    return Model(classes, fitted, max(0.5, least))


def _predicted(rows: DataFrame, model: Model) -> DataFrame:
    """The input's columns, `family` and `probability`: the likeliest class."""
    columns = rows.columns
    made = model.fitted.transform(rows)
    probabilities = vector_to_array("probability")
    classes = F.array(*map(F.lit, model.classes))
    best = F.get(classes, F.col("prediction").cast("int")).alias("family")
    return made.select(*columns, best, F.array_max(probabilities).alias("probability"))


def likeness(words: Column, family: Column) -> Column:
    """Best share of word triples that the paragraph has in common with a template of the
    family, of the shorter of both."""
    n = F.size(words)
    later = F.greatest(n - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, later), F.slice(words, 2, later), lambda a, b: F.concat_ws(" ", a, b))
    triples = F.array_distinct(F.zip_with(pairs, F.slice(words, 3, later), lambda p, c: F.concat_ws(" ", p, c)))
    triples = F.when(n < 3, F.array(F.concat_ws(" ", words))).otherwise(triples)
    found = F
    for name, templates in TEMPLATES.items():
        shares = []
        for template in [*templates, *SHORT_NAMES.get(name, [])]:
            own = _triples(_python_words(template))
            common = F.size(F.array_intersect(triples, F.array(*map(F.lit, own))))
            shares.append(common / F.least(F.size(triples), F.lit(len(own))))
        found = found.when(family == name, F.greatest(*shares, F.lit(0.0)))
    return found.otherwise(0.0)


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, `families` (sorted, without repeats) and `findings` (line, family, probability,
    likeness, in order of lines) of every document.

    Null and empty texts have none. Repeated rows and copies have equal findings: texts are
    classified once, by their MD5 digest. An empty table gives no rows; other columns are ignored.
    """
    text = whole_text(F.col(text_column))
    named = docs.select(F.col(id_column).alias("id"), F.unhex(F.md5(text)).alias("th"), text.alias("t"))
    told = stored(paragraphs(named), "license-paragraphs")
    some, none = told.where(F.size("found") > 0), told.where(F.size("found") == 0)
    each = some.select("th", F.explode("found").alias("p")).select("th", "p.line", F.col("p.family").alias("of"), "p.words")
    judged = _predicted(each.distinct(), model).where((F.col("family") == F.col("of")) & (F.col("probability") >= model.least))
    sure = judged.withColumn("likeness", likeness(F.col("words"), F.col("family"))).where(
        F.col("likeness") >= LIKENESS
    )
    best = sure.groupBy("th", "line", "family").agg(
        F.max("probability").alias("probability"), F.max("likeness").alias("likeness")
    )
    by_text = best.groupBy("th").agg(
        F.array_sort(F.collect_list(F.struct("line", "family", "probability", "likeness"))).alias("findings")
    )
    kind = by_text.schema["findings"].dataType.simpleString()
    nothing = F.array().cast(kind)
    # Texts without a paragraph, the empty ones among them, meet nobody.
    every = some.select("id", "th").join(by_text, "th", "left").select("id", "findings")
    every = every.union(none.select("id", nothing.alias("findings")))
    findings = F.coalesce("findings", nothing)
    return every.select(
        F.col("id").alias(id_column),
        F.array_sort(F.array_distinct(F.transform(findings, lambda f: f["family"]))).alias("families"),
        findings.alias("findings"),
    )
