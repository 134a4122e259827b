"""A training corpus out of documents: five stages, each one operator over all that is left.

Every stage but the last returns the columns of `documents`; a stage's rows are written as
Parquet in the shared folder and read again, so that the next one starts from a table and
a lost executor costs one stage at most.

Repeated ids are documents of their own; of rows equal in every column the second stage
keeps one. Further columns pass through all but the last stage, an empty table through all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.llm import packing, quality_rules, secret_scan, simhash, substring_dedup
from hydroframe.llm.common import stored
from hydroframe.llm.workload import REPEAT_WINDOW, SIMHASH_DISTANCE, SIMHASH_SHINGLE, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the learned decision list rejects go, null and empty texts among them."""
    rules = quality_rules.train(docs, load(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; texts without words are one group."""
    return simhash.deduplicated(docs, shingle=SIMHASH_SHINGLE, distance=SIMHASH_DISTANCE)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur elsewhere are cut out; a document of which no word is left goes."""
    left = substring_dedup.without_repeats(docs, window=REPEAT_WINDOW, length_column="n_chars")
    return left.where(F.length(F.trim(F.translate("text", "\t\n\x0b\f\r", "     "))) > 0)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker; documents stay, and null texts stay null."""
    model = secret_scan.train(secret_scan.planted_findings(docs), docs)
    found = secret_scan.scan(docs, model, path_column="source")
    length = F.when(F.size("findings") > 0, F.length("redacted")).otherwise(F.col("row.n_chars"))
    columns = {"text": F.col("redacted"), "n_chars": length.cast(docs.schema["n_chars"].dataType)}
    return found.select(*(columns.get(name, F.col(f"row.`{name}`")).alias(name) for name in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, and their places in sequences of at most 4096 tokens; a null text is empty."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("secret_scans", secrets),
    ("best_fit_packing", packed),
]

#: SQL can express neither the learned rules nor the forest; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
