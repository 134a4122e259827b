"""Tables and cells of pages."""

import pytest

from hydroframe.sources.html import (
    SITE_TYPE_COLUMNS,
    html_cells,
    html_table,
    page_tables,
    table_counts,
    table_rows,
)

HEAD = "<tr>" + "".join(f"<th>{name}</th>" for name in SITE_TYPE_COLUMNS) + "</tr>"
ROW = (
    "<tr class=r><td>ST</td><td> 10 </td><td>Y</td><td>NA</td>"
    "<td>Stream &amp; <b>river</b></td><td>two\n  lines</td><td>a &lt; b</td></tr>"
)
PAGE = f"<html><body><TABLE border='1'>\n<thead>{HEAD}</thead>\n<tbody>{ROW}\n{ROW.replace('10', '20')}</tbody></TABLE></body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(
        [("one", PAGE), ("none", "<p>no table</p>"), ("two", PAGE + PAGE), ("null", None)],
        "url string, html string",
    )


def test_code_table(pages):
    df = html_table(pages.where("url = 'one'"), "url")
    assert [f.dataType.simpleString() for f in df.schema][2:] == list(SITE_TYPE_COLUMNS.values())
    rows = df.orderBy("row").collect()
    assert tuple(rows[0])[2:] == ("ST", 10, "Y", None, "Stream & river", "two lines", "a < b")
    assert rows[1]["Site Tp Srt Nu"] == 20


def test_pages_without_exactly_one_table(pages):
    assert {r.url: r.tables for r in table_counts(pages, "url").collect()}["two"] == 2
    assert {r.url for r in html_table(pages, "url", strict=False).select("url").collect()} == {"one"}
    for url in ("none", "two"):
        with pytest.raises(Exception, match="expected one table in"):
            html_table(pages.where(f"url = '{url}'"), "url").collect()


def test_cells_by_pattern(pages):
    got = html_cells(pages.where("url = 'one'"), "url", "<td>(.*?)</td>").collect()
    assert [(r.i, r.cell) for r in got][:2] == [(0, "ST"), (1, " 10 ")]


INNER = "<table class=in><tr><td>x</td></tr><tr><td>y<table><tr><td>deep</td></tr></table></td></tr></table>"
NESTED = (
    "<!-- <table> --><script>var t = '<table>';</script>"
    f"<TABLE><tr><th>a</th><th>b</th></tr><tr><td>1 {INNER} one</td><td>{INNER}</td></tr>"
    "<tr><td>2</td><td>two</td></tr></TABLE ></table>tail"
)


def test_nested_tables(spark):
    pages = spark.createDataFrame([("n", NESTED), ("open", "<table><tr><td>1</td></tr>"), ("none", None)], "url string, html string")
    got = html_table(pages.where("url = 'n'"), "url", {"a": "string", "b": "string"}).orderBy("row").collect()
    assert [(r.a, r.b) for r in got] == [("1 one", None), ("2", "two")]
    assert {r.url: (r.tables, r.nested) for r in table_counts(pages, "url").collect()} == {
        "n": (5, 4), "open": (1, 0), "none": (0, 0),
    }
    tables = page_tables(pages, "url")
    assert sorted((r.url, r.table, r.parent, r.depth) for r in tables.collect() if r.url == "n") == [
        ("n", 0, None, 0), ("n", 1, 0, 1), ("n", 2, 1, 2), ("n", 3, 0, 1), ("n", 4, 3, 2),
    ]
    rows = {(r.table, r.row): r.cells for r in table_rows(tables, ["url", "table"]).collect() if r.url == "n"}
    assert rows[0, 2] == ["2", "two"] and rows[1, 0] == rows[3, 0] == ["x"] and rows[4, 0] == ["deep"]
    assert rows[1, 1] == rows[3, 1] == ["y"]
    second = html_table(pages, "url", {"x": "string"}, table=3, strict=False).collect()
    assert [(r.url, r.x) for r in second] == [("n", "y")]
    with pytest.raises(Exception, match="no table 3 in open"):
        html_table(pages.where("url = 'open'"), "url", {"x": "string"}, table=3).collect()


def test_a_page_of_many_tables(spark):
    page = "<table><tr><td>0</td></tr>" * 300 + "</table>" * 300 + "".join(
        f"<table><tr><td>{n}</td></tr></table>" for n in range(300)
    )
    tables = page_tables(spark.createDataFrame([(1, page)], "id int, html string"), "id")
    got = tables.orderBy("table").collect()
    assert [r.depth for r in got] == [*range(300), *[0] * 300]
    assert got[599].html == "<tr><td>299</td></tr>"
