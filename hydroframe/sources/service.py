"""Responses of the station service, fetched by the executors.

Two entries share one reader. `fetch_text` takes a request plan of any size; its
addresses never pass through the driver. The `station_service` data source takes a
list of addresses as an option, one input partition each.

A response becomes pieces of whole lines, each led by the response's own header and type
row, so that its lines are taken apart by Spark without a join. It is read once, in order,
and landed before it is parsed (`landed`): a retry of a later stage asks nobody again.

`land_requests` keeps a journal of the answers next to them: a request that fails is told, and
asked again in a round of its own, and none that was answered is.
"""

from __future__ import annotations

import http.client
import io
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hydroframe.sources.rdb import RdbText, is_content_line

TEXT_SCHEMA = "file string, block bigint, value string"
ARROW_SCHEMA = pa.schema([("file", pa.string()), ("block", pa.int64()), ("value", pa.string())])
# Characters of a piece, but for its header and the end of its last line.
PIECE = 1 << 20
TIMEOUT_SECONDS = 600


def response_pieces(url: str) -> Iterator[tuple[int, str]]:
    """Number and text of each piece; the first has the leading comments, too."""
    with urlopen(url, timeout=TIMEOUT_SECONDS) as response:
        text = io.TextIOWrapper(response, encoding="utf-8", errors="replace")
        leading, head = [], []
        for line in text:
            leading.append(line)
            if is_content_line(line.rstrip("\n")):
                head.append(line)
                if len(head) == 2:
                    break
        begin, number = "".join(leading), 0
        while (data := text.read(PIECE)) or not number:
            yield number, begin + data + text.readline()
            begin, number = "".join(head), number + 1


def _batch(file: str, number: int, value: str) -> pa.RecordBatch:
    columns = [pa.array([x], field.type) for x, field in zip((file, number, value), ARROW_SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=ARROW_SCHEMA)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for url, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for number, value in response_pieces(url):
                yield _batch(name, number, value)


def fetch_text(
    plan: DataFrame, url: str = "url", name: str | None = None, tasks: int | None = None
) -> DataFrame:
    """(file, block, value): every planned response in pieces; `tasks` requests run at a time.

    `file` is the address, or the plan's column `name` if that is one per request.
    """
    tasks = tasks or plan.sparkSession.sparkContext.defaultParallelism
    return (
        plan.select(F.col(url).cast("string"), F.col(name or url).cast("string").alias("name"))
        .repartition(tasks)
        .mapInArrow(_fetch, TEXT_SCHEMA)
    )


#: Rounds of requests: those that failed in one are asked again in the next.
ROUNDS = 3
PIECE_KIND, DONE, FAILED = "piece", "done", "failed"
JOURNAL_SCHEMA = f"{TEXT_SCHEMA}, kind string"
_JOURNAL_FIELDS = pa.schema([*ARROW_SCHEMA, pa.field("kind", pa.string())])


def _journal_row(file: str, number: int, value: str | None, kind: str) -> pa.RecordBatch:
    columns = [pa.array([x], f.type) for x, f in zip((file, number, value, kind), _JOURNAL_FIELDS)]
    return pa.RecordBatch.from_arrays(columns, schema=_JOURNAL_FIELDS)


def _fetch_or_tell(
    read: Callable[[str], Iterable[tuple[int, str]]], batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """The pieces of each response, and behind them whether it came to its end."""
    for batch in batches:
        for url, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            number = 0
            try:
                for number, value in read(url):
                    yield _journal_row(name, number, value, PIECE_KIND)
            except (OSError, http.client.HTTPException) as error:
                yield _journal_row(name, number, f"{url}: {error}", FAILED)
            else:
                yield _journal_row(name, number, None, DONE)


def land_requests(
    plan: DataFrame,
    folder: str,
    url: str = "url",
    name: str | None = None,
    tasks: int | None = None,
    rounds: int = ROUNDS,
    read: Callable[[str], Iterable[tuple[int, str]]] = response_pieces,
) -> RdbText:
    """Land every planned response in `folder` and return them as station text.

    A failed request fails no task and loses no other's answer: it is told in the journal, and
    those told are asked again, `rounds` times at most, then it is an error. Called again for
    a folder, the rounds go on from its journal. `name` is one per request; `read` gives the
    numbered pieces of an address.
    """
    spark = plan.sparkSession
    tasks = tasks or spark.sparkContext.defaultParallelism
    asked = plan.select(F.col(url).cast("string"), F.col(name or url).cast("string").alias("file"))
    for _ in range(rounds):
        journal = _journal(spark, folder)
        todo = asked if journal is None else asked.join(journal.where(F.col("kind") == DONE), "file", "left_anti")
        if journal is not None and todo.isEmpty():
            break
        answers = todo.select(url, "file").repartition(tasks).mapInArrow(partial(_fetch_or_tell, read), JOURNAL_SCHEMA)
        answers.write.partitionBy("kind").parquet(f"{folder}/round={uuid.uuid4().hex}")
    return read_requests(asked, folder)


def _rounds(spark: SparkSession, folder: str) -> list[str]:
    """Rounds whose writer has finished."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(paths(folder)):
        return []
    found = [status.getPath() for status in system.listStatus(paths(folder))]
    return sorted(p.toString() for p in found if system.exists(paths(p, "_SUCCESS")))


def _journal(spark: SparkSession, folder: str) -> DataFrame | None:
    """(file, block, value, kind, round) of all finished rounds; None before the first."""
    rounds = _rounds(spark, folder)
    if not rounds:
        return None
    schema = f"{JOURNAL_SCHEMA}, round string"
    return spark.read.schema(schema).option("basePath", folder).parquet(*rounds)


def read_requests(asked: DataFrame, folder: str) -> RdbText:
    """The landed responses of `asked` (file); an error if one is not there in full."""
    journal = _journal(asked.sparkSession, folder)
    done = journal.where(F.col("kind") == DONE)
    failed = journal.where(F.col("kind") == FAILED)
    told = failed.join(done, "file", "left_anti").select("file", "value").distinct().limit(10).collect()
    if told:
        raise OSError("no answer from " + "; ".join(row.value for row in told) + f" (landed: {folder})")
    pieces = journal.where(F.col("kind") == PIECE_KIND)
    if not failed.isEmpty():
        # Of a response that broke off, pieces are there that do not count.
        pieces = pieces.join(done.select("file", "round"), ["file", "round"], "left_semi")
    return RdbText(documents=pieces.select("file", "block", "value"))


def landed(pieces: DataFrame, folder: str) -> RdbText:
    """Write fetched pieces to `folder` and return them as station text."""
    pieces.write.parquet(folder)
    return read_landed(pieces.sparkSession, folder)


def read_landed(spark: SparkSession, folder: str) -> RdbText:
    return RdbText(documents=spark.read.schema(TEXT_SCHEMA).parquet(folder))


def fetch_pages(plan: DataFrame, url: str = "url", tasks: int | None = None) -> DataFrame:
    """(url, html): every planned response as one row."""
    tasks = tasks or plan.sparkSession.sparkContext.defaultParallelism

    def fetch(batches):
        for batch in batches:
            for address in batch.column(0).to_pylist():
                with urlopen(address, timeout=TIMEOUT_SECONDS) as response:
                    html = response.read().decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"url": [address], "html": [html]})

    return (
        plan.select(F.col(url).cast("string"))
        .repartition(tasks)
        .mapInArrow(fetch, "url string, html string")
    )


class StationService(DataSource):
    """`spark.read.format("station_service").option("urls", "<one address per line>")`."""

    @classmethod
    def name(cls) -> str:
        return "station_service"

    def schema(self) -> str:
        return TEXT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StationServiceReader(self.options.get("urls", ""))


class Request(InputPartition):
    def __init__(self, url: str):
        self.url = url


class StationServiceReader(DataSourceReader):
    def __init__(self, urls: str):
        self.urls = urls.split()

    def partitions(self) -> list[InputPartition]:
        return [Request(url) for url in self.urls]

    def read(self, partition: Request) -> Iterator[pa.RecordBatch]:
        for number, value in response_pieces(partition.url):
            yield _batch(partition.url, number, value)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StationService)
