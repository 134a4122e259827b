"""Helpers shared by the operators: tables in the shared folder, words, whole rows carried along."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.session import shared_folder

#: One word: everything between the six white-space characters of ASCII.
#: `bytes.split()` cuts at the same six, so Python and Spark agree on words.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as a table in the shared folder, and read from there.

    The lineage ends here: a lost executor costs its running tasks, not the steps before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def whole_text(text: Column) -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(text, F.lit(""))


#: Rows of an Arrow batch: texts may be long, and JVM and Python worker hold a batch each.
BATCH_ROWS = 1000


def small_batches(docs: DataFrame) -> DataFrame:
    """The frame itself, after seeing to it that its session sends few rows at a time to Python."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return docs


def some_texts(docs: DataFrame, text: Column, most: int) -> DataFrame:
    """`text`: `most` of the different texts, those of the smallest hashes.

    The bound is found over the hashes alone, so that no text is sorted or sent for it.
    """
    hashed = docs.select(F.xxhash64(text).alias("h"))
    last = hashed.distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    chosen = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).where(F.col("h") <= F.lit(last))
    return chosen.dropDuplicates(["h"]).select("text")


def aside(docs: DataFrame) -> list[Column]:
    """The input's columns under names of our own, so that no column added can clash with them.

    They are carried flat and become a struct at the end (`row_of`): Spark 4.1 loses fields
    of a struct that passes several generators.
    """
    return [F.col(f"`{name}`").alias(f"__in_{n}") for n, name in enumerate(docs.columns)]


def carried(docs: DataFrame) -> list[str]:
    return [f"__in_{n}" for n in range(len(docs.columns))]


def row_of(docs: DataFrame) -> Column:
    """The input's row as one struct `row`."""
    named = zip(carried(docs), docs.columns)
    return F.struct(*(F.col(ours).alias(name) for ours, name in named)).alias("row")


#: Rows handed on at a time by `streamed`, and characters in them.
STREAM_ROWS, STREAM_CHARS = 1000, 4 << 20


def streamed(rows: DataFrame, made: Callable[[Iterator[dict]], Iterable[dict]], columns: str) -> DataFrame:
    """`made` over the rows of each partition, in their order; `conv_id` keeps its type.

    A partition is never held as a whole: rows come and go in small Arrow batches.
    """
    fields = [column.split(" ") for column in columns.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    kinds |= {f"array<{name}>": pa.list_(kind) for name, kind in kinds.items()}
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("conv_id").type
        schema = pa.schema([("conv_id", id_type), *((name, kinds[kind]) for name, kind in fields)])

        def found() -> Iterator[dict]:
            yield from first.to_pylist()
            for batch in batches:
                yield from batch.to_pylist()

        held, size = [], 0
        for row in made(found()):
            held.append(row)
            size += sum(len(value) for value in row.values() if isinstance(value, str))
            if len(held) == STREAM_ROWS or size >= STREAM_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return small_batches(rows).mapInArrow(run, f"conv_id {kind}, {columns}")
