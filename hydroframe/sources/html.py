"""Cells and tables of HTML pages, one page per row, without leaving the row.

Tables may stand inside others. One scan over a page's table tags counts how deep it is, and so
gives each piece of the page between two such tags to the innermost table open there. A
table's own rows are those of its pieces: what a table inside one of its cells says is that
table's. Comments, scripts and style sheets hold no tables. A tag that closes nothing is
ignored, a table that is never closed goes on to the end of the page.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.cells import text_cell

# The columns of the site type code table and their types.
SITE_TYPE_COLUMNS = {
    "Site Tp Cd": "string",
    "Site Tp Srt Nu": "int",
    "Site Tp Vld Fg": "string",
    "Site Tp Prim Fg": "string",
    "Site Tp Nm": "string",
    "Site Tp Ln": "string",
    "Site Tp Ds": "string",
}

TABLE_TAG = r"(?i)</?table\b[^>]*>"
HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b[^>]*>.*?</\1\s*>"
ROW = r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"
CELL = r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"

# Character entities; the ampersand comes last.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"',
    "&#39;": "'", "&apos;": "'", "&amp;": "&",
}


def html_cells(pages: DataFrame, key: str, pattern: str, html: str = "html") -> DataFrame:
    """(key, i, cell): every match of the pattern's first group, numbered per page."""
    found = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("i", "cell"))


def _plain(cell: Column) -> Column:
    text = F.regexp_replace(cell, r"(?s)<[^>]*>", "")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _scanned(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pieces, scan): the page cut at its table tags, and for each piece its innermost table.

    `scan.owners` has a table's number, in order of the opening tags, or -1; `scan.parents` and
    `scan.depths` tell for each table which one it stands in, and in how many.
    """
    shown = pages.select(key, F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "").alias("_html"))
    cut = shown.select(
        key,
        F.split("_html", TABLE_TAG).alias("pieces"),
        F.regexp_extract_all(F.col("_html"), F.lit(TABLE_TAG), F.lit(0)).alias("tags"),
    )
    none = F.array().cast("array<int>")
    outside = F.lit(-1)
    start = F.struct(
        none.alias("open"), F.array(outside).alias("owners"), none.alias("parents"), none.alias("depths")
    )

    def last(numbers: Column) -> Column:
        return F.coalesce(F.try_element_at(numbers, F.lit(-1)), outside)

    def step(state: Column, tag: Column) -> Column:
        closes, opened = tag.startswith("</"), state["open"]
        after = F.when(closes, F.slice(opened, F.lit(1), F.greatest(F.size(opened) - 1, F.lit(0)))).otherwise(
            F.concat(opened, F.array(F.size(state["parents"])))
        )
        return F.struct(
            after.alias("open"),
            F.concat(state["owners"], F.array(last(after))).alias("owners"),
            F.when(closes, state["parents"]).otherwise(F.concat(state["parents"], F.array(last(opened)))).alias("parents"),
            F.when(closes, state["depths"]).otherwise(F.concat(state["depths"], F.array(F.size(opened)))).alias("depths"),
        )

    return cut.select(key, "pieces", F.aggregate("tags", start, step).alias("scan"))


def _own(number: Column) -> Column:
    """The page's pieces that belong to a table."""
    owned = F.filter(F.arrays_zip(F.col("pieces").alias("piece"), F.col("scan.owners").alias("owner")), lambda p: p["owner"] == number)
    return F.array_join(F.transform(owned, lambda p: p["piece"]), "")


def page_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, table, parent, depth, html): every table, in order of the opening tags, without those inside it."""
    each = _scanned(pages, key, html).withColumn("table", F.explode(F.sequence(F.lit(0), F.size("scan.parents") - 1)))
    return each.where("table >= 0 and table < size(scan.parents)").select(
        key,
        "table",
        F.nullif(F.get("scan.parents", "table"), F.lit(-1)).alias("parent"),
        F.get("scan.depths", "table").alias("depth"),
        _own(F.col("table")).alias("html"),
    )


def table_rows(tables: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """(keys, row, cells): the rows of each table of `page_tables`, header rows included, as plain text."""
    rows = F.regexp_extract_all(F.col(html), F.lit(ROW), F.lit(1))
    found = tables.select(*keys, F.posexplode(rows).alias("row", "_row"))
    cells = F.transform(F.regexp_extract_all(F.col("_row"), F.lit(CELL), F.lit(1)), _plain)
    return found.select(*keys, "row", cells.alias("cells"))


def table_counts(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, tables, nested): how many tables each page holds, and how many of them inside others."""
    inside = F.filter("scan.depths", lambda d: d > 0)
    return _scanned(pages, key, html).select(
        key, F.size("scan.depths").alias("tables"), F.size(inside).alias("nested")
    )


def html_table(
    pages: DataFrame,
    key: str,
    columns: dict[str, str] = SITE_TYPE_COLUMNS,
    html: str = "html",
    strict: bool = True,
    table: int | None = None,
) -> DataFrame:
    """One table of each page as typed columns, found by name in its first row.

    It is the only table that stands in no other, or the one of number `table` in order of the
    opening tags. In strict mode a page without it fails the query; otherwise it has no rows here and shows
    up in `table_counts`.
    """
    outer = F.filter(F.transform("scan.depths", lambda d, at: F.when(d == 0, at)), lambda at: at.isNotNull())
    complaint = F.concat(
        F.lit("expected one table in "), F.col(key).cast("string"),
        F.lit(", found "), F.size("outer").cast("string"),
    ) if table is None else F.concat(F.lit(f"no table {table} in "), F.col(key).cast("string"))
    other = F.raise_error(complaint).cast("string") if strict else F.lit(None)
    if table is None:
        there, wanted = F.size("outer") == 1, F.get("outer", F.lit(0))
    else:
        there, wanted = F.size("scan.depths") > table, F.lit(table)
    rows = F.regexp_extract_all(F.col("table"), F.lit(ROW), F.lit(1))
    header = F.transform(F.regexp_extract_all(F.get("rows", F.lit(0)), F.lit(CELL), F.lit(1)), _plain)
    body = F.coalesce(F.slice("rows", 2, F.size("rows")), F.array().cast("array<string>"))
    split = (
        _scanned(pages, key, html)
        .select(key, "pieces", "scan", outer.alias("outer"))
        .select(key, F.when(there, _own(wanted)).otherwise(other).alias("table"))
        .select(key, rows.alias("rows"))
        .select(key, header.alias("names"), body.alias("body"))
        .select(key, "names", F.posexplode(F.concat("body")).alias("row", "html_row"))
        .withColumn("cells", F.regexp_extract_all(F.col("html_row"), F.lit(CELL), F.lit(1)))
    )
    cells = [
        _typed(text_cell(_plain(F.get("cells", F.array_position("names", name) - 1))), kind, strict)
        .alias(name)
        for name, kind in columns.items()
    ]
    return split.select(key, "row", *cells)


def _typed(cell: Column, kind: str, strict: bool) -> Column:
    if kind == "string":
        return cell
    return cell.cast(kind) if strict else cell.try_cast(kind)
