"""Parameter dictionaries that station files carry in their comment header.

The table starts after a marker line, whose words give the column names and the
column offsets, and ends at the first bare `#`. Columns have fixed width; the last
one runs to the end of the line.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.sources.rdb import RdbText, is_comment, is_content, split_lines

# Fixed value: the marker line's text.
MARKER = "TS_ID       Parameter Description"

# The start of the first line that is neither a comment nor blank.
FIRST_CONTENT = r"(^|[\r\n]) *[^# \r\n]"


def parameter_table(text: RdbText, marker: str = MARKER) -> DataFrame:
    """(file, line, <one string column per word of the marker>) for every file.

    A file without marker has no rows; without a closing `#` the table runs to the
    end of the leading comment lines.
    """
    parts = []
    if text.documents is not None:
        parts.append(_from_documents(text.documents, marker))
    if text.lines is not None:
        parts.append(_from_lines(text.head_lines, marker))
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return table.select("file", "line", *_columns(marker))


def _comment_text(line: Column) -> Column:
    return F.substr(line, F.lit(2))


def _is_bare(line: Column) -> Column:
    return _trimmed(_comment_text(line)) == ""


def _trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t"))


def _columns(marker: str) -> list[Column]:
    """Cells of `value`, cut at the marker's word offsets from `start`."""
    words = [(m.group(), m.start()) for m in re.finditer(r"\S+", marker)]
    text = _comment_text(F.col("value"))
    cells = []
    for i, (word, offset) in enumerate(words):
        begin = F.col("start") + offset
        if i + 1 < len(words):
            cell = F.substr(text, begin, F.lit(words[i + 1][1] - offset))
        else:
            cell = F.substr(text, begin)
        cells.append(_trimmed(cell).alias(word))
    return cells


def _from_documents(documents: DataFrame, marker: str) -> DataFrame:
    # Cut the leading comments off first: the data behind them is never split.
    body_at = F.regexp_instr("value", F.lit(FIRST_CONTENT))
    leading = F.when(F.col("body_at") == 0, F.col("value")).otherwise(
        F.substr("value", F.lit(1), F.col("body_at"))
    )
    comments = F.filter(split_lines(leading), is_comment)
    starts = F.transform("comments", lambda line: F.instr(_comment_text(line), marker))
    first = F.array_position(F.transform("starts", lambda at: at > 1), True).cast("int")
    table = (
        documents.withColumn("body_at", body_at)
        .select("file", comments.alias("comments"))
        .withColumn("starts", starts)
        .withColumn("at", first)
        .where("at > 0")
        .select(
            "file",
            F.get("starts", F.col("at") - 1).alias("start"),
            F.slice("comments", F.col("at") + 1, F.size("comments")).alias("rest"),
        )
        .withColumn("end", F.array_position(F.transform("rest", _is_bare), True).cast("int"))
    )
    kept = F.when(F.col("end") == 0, F.col("rest")).otherwise(
        F.slice("rest", F.lit(1), F.col("end") - 1)
    )
    return table.select("file", "start", F.posexplode(kept).alias("line", "value")).select(
        "file", "start", F.col("line").cast("bigint").alias("line"), "value"
    )


def _from_lines(head_lines: DataFrame, marker: str) -> DataFrame:
    """The same with one row of bounds per file, which the comments are joined with once.

    A table begins behind the first marker and stops at the next bare or content line.
    A file whose data begin before its marker has none. The bounds come from one
    aggregation: of bare lines only their numbers are gathered.
    """
    value, line = F.col("value"), F.col("line")
    comment = is_comment(value)
    start = F.when(comment, F.instr(_comment_text(value), marker))
    bounds = (
        head_lines.where(comment | is_content(value))
        .groupBy("file")
        .agg(
            F.min(F.when(start > 1, F.struct(line, start.alias("start")))).alias("marker"),
            F.min(F.when(~comment, line)).alias("content"),
            F.collect_list(F.when(comment & _is_bare(value), line)).alias("bare"),
        )
        .where("marker is not null and (content is null or content > marker.line)")
        .select(
            "file",
            F.col("marker.line").alias("first"),
            F.col("marker.start").alias("start"),
            F.least("content", F.array_min(F.filter("bare", lambda b: b > F.col("marker.line")))).alias("last"),
        )
    )
    inside = (line > F.col("first")) & (F.col("last").isNull() | (line < F.col("last")))
    comments = head_lines.where(comment).select("file", "line", "value")
    return comments.join(bounds, "file").where(inside).select("file", "start", "line", "value")
