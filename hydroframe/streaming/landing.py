"""Incremental refresh of the store from a folder station files arrive in."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hydroframe.plans.store import Dataset, Store
from hydroframe.sources.rdb import scan

MAX_FILES = 10_000
# What the journal says of a file: a file that changes in any of these is a new one.
JOURNAL_SCHEMA = "path string, modificationTime timestamp, length bigint"
ARRIVED = "arrived"


def literal_path(path: str) -> str:
    """The path as a pattern that only it fits."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def journal_folder(checkpoint: str) -> str:
    return f"{checkpoint.rstrip('/')}/journal"


def arrivals(spark: SparkSession, landing: str, checkpoint: str) -> DataFrame:
    """(path, modificationTime, length) of the files in `landing` that the journal does not have.

    No file is opened, and files of any age count: what is new is told by the journal alone.
    """
    journal = spark.read.schema(JOURNAL_SCHEMA).parquet(journal_folder(checkpoint))
    listed = spark.read.format("binaryFile").load(landing).select("path", "modificationTime", "length").distinct()
    return listed.join(journal, ["path", "modificationTime", "length"], "left_anti")


def journalled(spark: SparkSession, landing: str, checkpoint: str, max_files: int = MAX_FILES) -> None:
    """Enter new files into the journal, `max_files` at most into one of its own files.

    What a lost job left half-entered is entered by the next run: an entry counts from the moment
    its journal file is there.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(journal_folder(checkpoint))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    new = arrivals(spark, landing, checkpoint)
    new.write.mode("append").option("maxRecordsPerFile", max_files).parquet(journal_folder(checkpoint))


def stream_upsert(
    spark: SparkSession,
    landing: str,
    store: Store,
    dataset: Dataset,
    now: Column,
    checkpoint: str,
    max_files: int = MAX_FILES,
) -> StreamingQuery:
    """Upsert every file that arrived since the last run, then stop.

    New files are entered into a journal next to the stream's checkpoint; the stream reads the
    journal, so what it remembers grows with the runs and not with the files, and a file is
    taken once whatever its modification time. A file that was written again is a new one.
    Each micro-batch reads its files, `max_files` at most, with the batch reader. Repeating a
    micro-batch after a failure changes nothing: the upsert is idempotent.

    Every cell keeps the modification time and name of the file it came from. The later file
    wins, so the result depends neither on `max_files` nor on which run a file came in.
    Observations without a readable time, and lines that fit no header, are set aside.
    """
    writer = (ARRIVED, "file")
    order = (*writer, *(c for c in dataset.order if c not in writer))
    ordered = replace(dataset, order=order, stamp=writer)

    def refresh(batch: DataFrame, _: int) -> None:
        paths = [literal_path(row.path) for row in batch.select("path").distinct().collect()]
        if not paths:
            return
        text = scan(spark, paths, arrival=ARRIVED)
        store.commit(ordered, None, store.routed(dataset.name, text), now)

    journalled(spark, landing, checkpoint, max_files)
    names = (
        spark.readStream.schema(JOURNAL_SCHEMA)
        .option("maxFilesPerTrigger", 1)
        .parquet(journal_folder(checkpoint))
        .select("path")
    )
    return (
        names.writeStream.foreachBatch(refresh)
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
        .trigger(availableNow=True)
        .start()
    )
