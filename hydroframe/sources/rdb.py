"""Self-describing tab-separated station files ("RDB").

A file holds `#` comment lines, a line of column names, a line of type codes and
data lines. Every file brings its own header, so files are never read with one
common schema: each data line is matched with the header of its own file.

Files up to `whole_file_limit` bytes are read as one row each. Header and data
lines then sit in the same row and are taken apart without join or shuffle.
Larger files are read line by line in many splits; their data lines are joined
with their headers, which are broadcast once their measured size is small. Larger headers
are repeated for each part of their file and joined by file and part, so that no file is
one key, however large it is. Tasks read the headers, each its file up to the type row.

One rule holds in every layout and however files are split. A comment begins with `#`,
blanks before it allowed; a line of blanks is nothing; the first other line is the
header, the second the type row, and a line that repeats either word for word is no data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroframe.functions.cells import known_code, typed_cell
from hydroframe.session import shared_folder

WHOLE_FILE_LIMIT = 32 << 20
BROADCAST_LIMIT = 64 << 20
MOST_COLUMNS = 2000
# Bytes of a file whose lines share one copy of its header, where headers are not broadcast.
PART_BYTES = 128 << 20
# The header pass: lines that a task gets at a time, and a size that no file has.
HEAD_LINES, WHOLE = 64, 1 << 60
LINE_COLUMNS = "file string, block bigint, line bigint, value string"
HEAD_SCHEMA = f"{LINE_COLUMNS}, parts bigint"


def split_lines(text: Column) -> Column:
    """The text's lines, whatever ends them.

    Splitting at one character is several times faster than at a pattern, so other line
    ends are replaced first where a text has any.
    """
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.split(F.when(text.contains("\r"), unix).otherwise(text), "\n")


def is_comment(line: Column) -> Column:
    return line.startswith("#")


def is_content(line: Column) -> Column:
    """Neither a comment nor blank: a header, type or data line."""
    return ~F.ltrim(line).substr(1, 1).isin("", "#")


def is_content_line(line: str) -> bool:
    """`is_content` of one line in Python, for the few lines a file or response begins with."""
    return line.lstrip(" ")[:1] not in ("", "#")


def fits_header() -> Column:
    """At most `width` cells; cheaper than splitting the line a second time."""
    return F.expr(r"substring_index(value, '\t', width) <=> value")


def position_in(names: Column, name: str | Column) -> Column:
    """0-based position of a column in a header, -1 if the header lacks it."""
    return (F.array_position(names, name) - 1).cast("int")


@dataclass(frozen=True)
class RdbText:
    """Station text in one or both of its two layouts.

    documents: (file, value), one row per whole file; with `block` a row is one piece of
        a file, which begins with the file's header and type row.
    lines: (file, block, line, value), ordered by (block, line) within a file.
    head_lines: lines of the same form that hold every comment, header and type line; with
        `parts`, the number of their file's parts, `lines` have a `part` below it.
    broadcast_heads: the headers of `lines` were measured and fit a broadcast.
    carried: further columns of documents and lines that every row keeps.
    """

    documents: DataFrame | None = None
    lines: DataFrame | None = None
    head_lines: DataFrame | None = None
    broadcast_heads: bool = False
    carried: tuple[str, ...] = ()

    def heads(self) -> DataFrame:
        """(file, names, codes) of every file that has a header."""
        parts = []
        if self.documents is not None:
            heads = _document_heads(self.documents).where("names is not null")
            parts.append(heads.select("file", "names", "codes"))
        if self.lines is not None:
            parts.append(line_heads(self.head_lines))
        return _stacked(parts)

    def columns(self) -> dict[str, str]:
        """Names and type codes shared by all files; an error if headers differ."""
        found = self.heads().select("names", "codes").distinct().limit(2).collect()
        if len(found) > 1:
            raise ValueError(
                f"files have different headers, such as {found[0].names} and {found[1].names}; "
                "name the wanted columns, merge them, or read observations in long form"
            )
        return dict(zip(found[0].names, found[0].codes)) if found else {}

    def merged_columns(self, most: int = MOST_COLUMNS) -> dict[str, str]:
        """Columns of all headers together, `most` at most; an error if one has two types."""
        cells = F.posexplode(F.arrays_zip("names", "codes")).alias("at", "column")
        found = (
            self.heads()
            .select(cells)
            .groupBy(F.col("column.names").alias("name"))
            .agg(F.min("at").alias("at"), F.collect_set(F.right("column.codes", F.lit(1))).alias("codes"))
            .orderBy("at", "name")
            .limit(most + 1)
            .collect()
        )
        if len(found) > most:
            raise ValueError(f"more than {most} columns; read observations in long form")
        for row in found:
            if len(row.codes) > 1:
                raise ValueError(f"{row.name} has several types: {sorted(row.codes)}")
        return {row.name: row.codes[0] for row in found}

    def rows(self, *head_columns: Column, strict: bool = False, rejected_as: str | None = None) -> DataFrame:
        """(file, block, line, cells) of every data line that fits its header.

        `head_columns` are expressions over `names` and `codes`. They are computed
        once per file and carried along with each of its lines. In strict mode a
        line with too many cells fails the query. `rejected_as` keeps such lines and names
        a column that has their text, and null for the others.
        """
        fits = fits_header()
        if rejected_as is not None:
            return self._data_lines(head_columns).select(
                "*", F.when(~fits, F.col("value")).alias(rejected_as), F.split("value", "\t").alias("cells")
            ).drop("width", "value")
        if strict:
            complaint = F.concat(F.lit("too many cells in "), F.col("file"))
            fits = F.when(fits, True).otherwise(F.raise_error(complaint).cast("boolean"))
        return (
            self._data_lines(head_columns)
            .where(fits)
            .withColumn("cells", F.split("value", "\t"))
            .drop("width", "value")
        )

    def rejected(self) -> DataFrame:
        """(file, block, line, value) of data lines with more cells than columns."""
        return self._data_lines(()).where(~fits_header()).drop("width")

    def table(
        self,
        columns: dict[str, str] | None = None,
        strict: bool = False,
        file_as: str | None = None,
    ) -> DataFrame:
        """The data lines as typed columns; a column a file lacks is null there.

        `file_as` names a further column that tells which file a row came from.
        """
        if columns is None:
            columns = self.columns()
        places = [
            position_in(F.col("names"), name).alias(f"at_{i}") for i, name in enumerate(columns)
        ]
        return self.rows(*places, strict=strict).select(
            *([F.col("file").alias(file_as)] if file_as else []),
            *(
                typed_cell(F.get("cells", F.col(f"at_{i}")), code, strict, name).alias(name)
                for i, (name, code) in enumerate(columns.items())
            )
        )

    def _data_lines(self, head_columns: Iterable[Column]) -> DataFrame:
        parts = []
        if self.documents is not None:
            parts.append(_document_rows(self.documents, head_columns))
        if self.lines is not None:
            parts.append(self._line_rows(head_columns))
        return _stacked(parts)

    def _line_rows(self, head_columns: Iterable[Column]) -> DataFrame:
        texts = [F.array_join(c, "\t").alias(f"{c}_text") for c in ("names", "codes")]
        heads = line_heads(self.head_lines).select("file", *texts, _checked_width(), *head_columns)
        lines, on = self.lines, ["file"]
        if self.broadcast_heads:
            heads, lines = F.broadcast(heads), lines.drop("part")
        elif "part" in lines.columns:
            parts = self.head_lines.groupBy("file").agg(F.max("parts").alias("parts"))
            each = parts.select("file", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
            heads, on = heads.join(each, "file"), ["file", "part"]
        value = F.col("value")
        repeats_head = value.isin(F.col("names_text"), F.col("codes_text"))
        # One condition on both sides stays at the join; split in two, the part on the
        # line would be pushed below whatever computes the line and repeat it.
        is_data = F.when(repeats_head, False).otherwise(is_content(value))
        return lines.join(heads, on).where(is_data).drop("names_text", "codes_text", "part")


def _stacked(parts: list[DataFrame]) -> DataFrame:
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def _checked_width() -> Column:
    """Number of columns, 0 without header; fails on a missing or unknown type row."""
    bad = (F.size("names") != F.size("codes")) | F.exists("codes", lambda code: ~known_code(code))
    complaint = F.concat(
        F.lit("no valid type row in "), F.col("file"), F.lit(": "),
        F.coalesce(F.array_join("codes", " "), F.lit("missing")),
    )
    return (
        F.when(F.isnull("names"), 0)
        .when(F.coalesce(bad, F.lit(True)), F.raise_error(complaint).cast("int"))
        .otherwise(F.size("names"))
        .alias("width")
    )


def _document_heads(documents: DataFrame) -> DataFrame:
    kept = [c for c in documents.columns if c != "value"]
    content = F.filter(split_lines(F.col("value")), is_content)
    return documents.select(*kept, content.alias("content")).select(
        *kept,
        "content",
        F.get("content", F.lit(0)).alias("names_text"),
        F.get("content", F.lit(1)).alias("codes_text"),
        F.split(F.get("content", F.lit(0)), "\t").alias("names"),
        F.split(F.get("content", F.lit(1)), "\t").alias("codes"),
    )


def _document_rows(documents: DataFrame, head_columns: Iterable[Column]) -> DataFrame:
    kept = [c for c in documents.columns if c not in ("file", "block", "value")]
    block = F.col("block") if "block" in documents.columns else F.lit(0)
    heads = _document_heads(documents).select(
        "file", block.cast("bigint").alias("block"), *kept, "content", "names_text", "codes_text",
        _checked_width(), *head_columns,
    )
    body = F.slice("content", 3, F.size("content"))
    carried = [c for c in heads.columns if c not in ("file", "block", "content")]
    rows = heads.select("file", "block", F.posexplode(body).alias("at", "value"), *carried)
    return rows.where(~F.col("value").isin(F.col("names_text"), F.col("codes_text"))).select(
        "file", "block", F.col("at").cast("bigint").alias("line"), "value",
        *(c for c in carried if c not in ("names_text", "codes_text")),
    )


def line_heads(head_lines: DataFrame) -> DataFrame:
    """(file, names, codes): the first two content lines of each file.

    The row-number limit is applied before the shuffle, too: each task sends at most
    two lines per file.
    """
    in_file = Window.partitionBy("file").orderBy("line")
    first_two = (
        head_lines.where(is_content(F.col("value")))
        .withColumn("nth", F.row_number().over(in_file))
        .where("nth <= 2")
    )
    header, types = F.col("nth") == 1, F.col("nth") == 2
    return first_two.groupBy("file").agg(
        F.split(F.max(F.when(header, F.col("value"))), "\t").alias("names"),
        F.split(F.max(F.when(types, F.col("value"))), "\t").alias("codes"),
    )


def heads_fit(heads: DataFrame) -> bool:
    """Whether headers fit a broadcast, by an upper bound of what is built from them: texts,
    names, codes and the places of each series."""
    text = F.octet_length(F.concat_ws("\t", "file", F.array_join("names", "\t"), F.array_join("codes", "\t")))
    size = F.lit(256) + text * 3 + F.coalesce(F.size("names"), F.lit(0)) * 192
    return (heads.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_LIMIT


def scan(
    spark: SparkSession,
    paths: str | list[str],
    whole_file_limit: int = WHOLE_FILE_LIMIT,
    arrival: str | None = None,
    **options: str,
) -> RdbText:
    """Station files under `paths`, each read in the layout that suits its size.

    The size condition is on file metadata, so either scan opens its own files only. A
    compressed file counts by its compressed size: lower the limit for those. `arrival`
    names a column for the files' modification time, which every row then carries.

    The headers of large files are read by a pass of their own, a task for each file, which
    stops behind the type row: it reads as much as files have leading lines, not as much as
    they have data, wherever the header stands. The driver opens no file.
    """
    name, size = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    carried = (arrival,) if arrival else ()
    extra = [F.col("_metadata.file_modification_time").alias(arrival)] if arrival else []
    documents = (
        spark.read.options(**options)
        .text(paths, wholetext=True)
        .where(size <= whole_file_limit)
        .select(name.alias("file"), *extra, "value")
    )
    listing = spark.read.format("binaryFile").options(**options).load(paths)
    if listing.where(F.col("length") > whole_file_limit).isEmpty():
        return RdbText(documents=documents, carried=carried)
    text = spark.read.options(**options).text(paths).where(size > whole_file_limit)
    block = F.col("_metadata.file_block_start")
    lines = text.select(
        name.alias("file"),
        block.alias("block"),
        F.floor(block / PART_BYTES).alias("part"),
        F.monotonically_increasing_id().alias("line"),
        *extra,
        "value",
    )
    head_lines = _landed_heads(spark, paths, whole_file_limit, options)
    return RdbText(
        documents=documents,
        lines=lines,
        head_lines=head_lines,
        broadcast_heads=heads_fit(line_heads(head_lines)),
        carried=carried,
    )


def _landed_heads(
    spark: SparkSession, paths: str | list[str], whole_file_limit: int, options: dict[str, str]
) -> DataFrame:
    """HEAD_SCHEMA of the lines that large files begin with, as a table in the shared folder.

    Each file is one partition of a session of its own, whose task asks for no more
    lines once it has the type row; so a file's beginning is read, by Spark's own reader.
    """
    folder = f"{shared_folder(spark)}/heads-{uuid.uuid4().hex}"
    side = spark.newSession()
    # A partition ends where the next file would make it larger than this: behind every file.
    side.conf.set("spark.sql.files.maxPartitionBytes", WHOLE)
    side.conf.set("spark.sql.files.openCostInBytes", WHOLE)
    side.conf.set("spark.sql.files.minPartitionNum", 1)
    side.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", HEAD_LINES)
    size = F.col("_metadata.file_size")
    text = side.read.options(**options).text(paths).where(size > whole_file_limit)
    parts = (F.floor(size / PART_BYTES) + 1).cast("bigint")
    begun = text.select(F.col("_metadata.file_path").alias("file"), parts.alias("parts"), "value")
    begun.mapInArrow(_leading_lines, HEAD_SCHEMA).write.parquet(folder)
    return spark.read.schema(HEAD_SCHEMA).parquet(folder)


def _leading_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a file up to its type row, or all if it has none; nothing behind it is asked for."""
    content = line = 0
    for batch in batches:
        values, n = batch.column("value").to_pylist(), 0
        while n < len(values) and content < 2:
            content += is_content_line(values[n])
            n += 1
        numbers = pa.array(range(line, line + n), pa.int64())
        head = batch.slice(0, n)
        yield pa.RecordBatch.from_arrays(
            [head.column("file"), pa.array([0] * n, pa.int64()), numbers, head.column("value"), head.column("parts")],
            ["file", "block", "line", "value", "parts"],
        )
        if content == 2:
            return
        line += n


def read_rdb(
    spark: SparkSession,
    paths: str | list[str],
    columns: dict[str, str] | None = None,
    strict: bool = False,
    **options: str,
) -> DataFrame:
    """Typed table of station files.

    With `columns` (name to type code) the files are read in one pass. Without, the
    headers are read first and must agree.
    """
    return scan(spark, paths, **options).table(columns, strict)
