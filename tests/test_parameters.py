"""Parameter tables in comment headers."""

import pytest

from hydroframe.operators.parameters import parameter_table
from hydroframe.sources import rdb
from hydroframe.sources.rdb import scan

HEADER = """\
# ---- WARNING ----
# Data provided for site 01455780
#            TS_ID       Parameter Description
#            16223       00095     Specific conductance, WELL #3
#            16224       00010     Temperature, water
#
# codes:
#     P  Provisional
#
site_no\tdatetime
15s\t20d
01455780\t2021-10-01
# late comment
"""


@pytest.fixture(params=[rdb.WHOLE_FILE_LIMIT, 0], ids=["whole", "lines"])
def table(request, spark, tmp_path):
    def read(**files):
        for name, text in files.items():
            (tmp_path / f"{name}.rdb").write_text(text)
        rows = parameter_table(scan(spark, str(tmp_path), whole_file_limit=request.param))
        found = {}
        for r in rows.orderBy("file", "line").collect():
            found.setdefault(r.file.rsplit("/")[-1], []).append((r.TS_ID, r.Parameter, r.Description))
        return found

    return read


SERIES = [("16223", "00095", "Specific conductance, WELL #3"), ("16224", "00010", "Temperature, water")]


def test_table(table):
    moved = HEADER.replace("#            ", "#  ").replace("01455780", "02")
    assert table(a=HEADER, b=moved) == {"a.rdb": SERIES, "b.rdb": SERIES}


def test_without_marker_no_rows(table):
    assert table(a=HEADER.replace("TS_ID", "TSID"), b="# x\n", c="") == {}


def test_marker_at_the_line_start_does_not_count(table):
    assert table(a=HEADER.replace("#            TS_ID", "#TS_ID")) == {}


def test_without_closing_line_it_runs_to_the_last_leading_comment(table):
    lines = [x for x in HEADER.splitlines() if x != "#"]
    got = table(a="\n".join(lines))["a.rdb"]
    assert got[:2] == SERIES
    assert len(got) == 4  # the code lines, but not the comment behind the data


def test_only_comments(table):
    head = HEADER.split("site_no\t")[0]
    assert table(a=head) == {"a.rdb": SERIES}


def test_long_comment_block(table):
    assert table(a="# x\n" * 500 + HEADER) == {"a.rdb": SERIES}


def test_marker_behind_the_data_does_not_count(table):
    data = "site_no\n15s\n01\n"
    assert table(a=data + HEADER.split("site_no\t")[0]) == {}


def test_first_of_two_markers(table):
    head = HEADER.split("site_no\t")[0]
    second = head.replace("16223", "99999")
    assert table(a=head + second) == {"a.rdb": SERIES}
