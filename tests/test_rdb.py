"""Station files: headers, types, bad cells, odd lines; both layouts of a file."""

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hydroframe.functions.cells import number_cell
from hydroframe.operators import observations
from hydroframe.sources import rdb
from hydroframe.sources.rdb import read_rdb, scan
from tests.settings import settings

STATIONS = (
    "# ---- WARNING ----\n"
    "#\n"
    "agency_cd\tsite_no\tstation_nm\tdec_lat_va\tdec_long_va\n"
    "5s\t15s\t50s\t16n\t16n\n"
    "AG\t01455780\tSTRAIT A BENICIA\t38.04\t-122.13\n"
    'AG\t11455781\tWELL #3 "OLD"\t\t-121.0\n'
    "AG\t11455782\tNA\t1e1\n"
)


def values(site, series, rows):
    return (
        f"# Data provided for site {site}\n"
        f"agency_cd\tsite_no\tdatetime\ttz_cd\t{series}\t{series}_cd\n"
        "5s\t15s\t20d\t6s\t14n\t10s\n" + "".join(f"AG\t{site}\t{row}\n" for row in rows)
    )


def put(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.rdb").write_bytes(text.encode())
    return str(folder)


@pytest.fixture(params=[rdb.WHOLE_FILE_LIMIT, 0], ids=["whole", "lines"])
def limit(request):
    return request.param


def test_station_list(spark, tmp_path, limit):
    df = scan(spark, put(tmp_path, a=STATIONS), whole_file_limit=limit).table()
    assert dict(df.dtypes) == {
        "agency_cd": "string", "site_no": "string", "station_nm": "string",
        "dec_lat_va": "double", "dec_long_va": "double",
    }
    rows = {r.site_no: r for r in df.collect()}
    assert len(rows) == 3
    assert "BENICIA" in rows["01455780"].station_nm
    # a number sign inside a line and quotes are text; null words are null
    assert rows["11455781"].station_nm == 'WELL #3 "OLD"'
    assert rows["11455781"].dec_lat_va is None
    assert rows["11455782"].station_nm is None
    # a short row ends in nulls
    assert rows["11455782"].dec_lat_va == 10.0 and rows["11455782"].dec_long_va is None


def test_files_keep_their_own_header(spark, tmp_path, limit):
    put(
        tmp_path,
        a=values("01", "16223_00095", ["2021-10-01 00:00\tPST\t1.5\tP", "2021-10-01 00:15\tPST\tIce\tP"]),
        b=values("02", "99_00010", ["2021-10-01 00:00\tPDT\t7\tA"]),
        comments="# nothing\n# here\n",
        empty="",
        only_head=values("03", "5_00010", []),
    )
    text = scan(spark, str(tmp_path), whole_file_limit=limit)
    long = observations.long_observations(text)
    got = {(r.site_no, r.ts_id, r.parameter_cd, r.datetime, r.tz_cd, r.value, r.raw, r.qualifier) for r in long.collect()}
    first, later = datetime(2021, 10, 1), datetime(2021, 10, 1, 0, 15)
    assert got == {
        ("01", "16223", "00095", first, "PST", 1.5, "1.5", "P"),
        ("01", "16223", "00095", later, "PST", None, "Ice", "P"),
        ("02", "99", "00010", first, "PDT", 7.0, "7", "A"),
    }
    assert [r.raw for r in observations.bad_tokens(long).collect()] == ["Ice"]
    with pytest.raises(ValueError, match="different headers"):
        text.table()
    named = text.table({"site_no": "15s", "99_00010": "14n"}).collect()
    assert sorted((r.site_no, r["99_00010"]) for r in named if r["99_00010"]) == [("02", 7.0)]
    assert len(named) == 3


def test_merged_columns(spark, tmp_path, limit):
    put(tmp_path, a="k\tv\n5s\t5n\na\t1\n", b="v\tw\tk\n8n\t20d\t9s\n2\t2021\tb\n")
    text = scan(spark, str(tmp_path), whole_file_limit=limit)
    assert text.merged_columns() == {"k": "s", "v": "n", "w": "d"}
    rows = text.table(text.merged_columns()).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [("a", 1.0, None), ("b", 2.0, datetime(2021, 1, 1))]
    put(tmp_path, c="k\n5n\n1\n")
    with pytest.raises(ValueError, match="k has several types"):
        scan(spark, str(tmp_path), whole_file_limit=limit).merged_columns()


def test_dates_and_codes(spark, tmp_path, limit):
    body = "k\tbegin\n5s\t20d\na\t1997\nb\t1997-12\nc\t1500-01-01\nd\tsoon\n"
    df = scan(spark, put(tmp_path, a=body), whole_file_limit=limit).table()
    assert dict(df.dtypes)["begin"] == "timestamp_ntz"
    assert {r.k: r.begin for r in df.collect()} == {
        "a": datetime(1997, 1, 1), "b": datetime(1997, 12, 1), "c": datetime(1500, 1, 1), "d": None,
    }


@pytest.mark.parametrize("types", ["5s\t9x", "5s", "5s\t5s\t5s", "5s\t"])
def test_bad_type_row_names_the_file(spark, tmp_path, limit, types):
    put(tmp_path, odd=f"k\tv\n{types}\na\t1\n")
    with pytest.raises(Exception, match="no valid type row in .*odd.rdb"):
        scan(spark, str(tmp_path), whole_file_limit=limit).table({"k": "5s"}).collect()


def test_too_many_cells_go_aside(spark, tmp_path, limit):
    text = scan(spark, put(tmp_path, a="k\tv\n5s\t5n\na\t1\nb\t2\t3\n"), whole_file_limit=limit)
    assert [tuple(r) for r in text.table().collect()] == [("a", 1.0)]
    assert [r.value for r in text.rejected().collect()] == ["b\t2\t3"]
    with pytest.raises(Exception, match="too many cells in"):
        text.table(strict=True).collect()


def test_strict_mode_rejects_bad_tokens(spark, tmp_path, limit):
    text = scan(spark, put(tmp_path, a="k\tv\n5s\t5n\na\t1\nb\t1d\nc\t\n"), whole_file_limit=limit)
    assert {r.k: r.v for r in text.table().collect()} == {"a": 1.0, "b": None, "c": None}
    with pytest.raises(Exception, match="v: not a double: 1d"):
        text.table(strict=True).collect()


def test_line_breaks_blank_lines_and_spaces(spark, tmp_path, limit):
    body = "# c\r\n\r\n   \r\nk\tv\r\n5s\t5n\r\na\t 1.5 \r\n\t\r\n"
    df = scan(spark, put(tmp_path, a=body), whole_file_limit=limit).table()
    # a line of tabs is a row of nulls, a line of blanks is none
    assert sorted(map(tuple, df.collect()), key=str) == [("a", 1.5), (None, None)]


def test_a_file_in_many_splits(spark, tmp_path):
    rows = [f"2021-10-01 00:{i % 60:02d}\tPST\t{i}\tP" for i in range(3000)]
    put(
        tmp_path,
        a=values("01", "1_00010", rows),
        b=values("02", "2_00010", rows[:2000]),
        c=STATIONS,
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", 8 << 10)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        text = scan(spark, str(tmp_path), whole_file_limit=2000)
        assert text.lines.rdd.getNumPartitions() > 8
        assert text.broadcast_heads
        long = observations.long_observations(text)
        got = long.groupBy("site_no", "ts_id").agg(F.count("*"), F.sum("value")).collect()
        assert sorted(map(tuple, got)) == [
            ("01", "1", 3000, float(sum(range(3000)))), ("02", "2", 2000, float(sum(range(2000)))),
        ]
        # lines keep their order across the splits of a file
        order = long.where("site_no = '01'").orderBy("block", "line").select("value").collect()
        assert [r.value for r in order] == [float(i) for i in range(3000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_splits_may_change_between_header_and_data_pass(spark, tmp_path):
    rows = [f"2021-10-01 00:{i % 60:02d}\tPST\t{i}\tP" for i in range(3000)]
    for i in range(4):
        put(tmp_path, **{f"f{i}": values(f"0{i}", f"{i}_00010", rows)})
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 8 << 10)
        text = scan(spark, str(tmp_path), whole_file_limit=0)
        long = observations.long_observations(text)
        for size in (8 << 10, 30 << 10, 128 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = long.groupBy("site_no", "ts_id").agg(F.count("*"), F.sum("value")).collect()
            assert sorted(map(tuple, got)) == [
                (f"0{i}", str(i), 3000, float(sum(range(3000)))) for i in range(4)
            ]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.fixture(params=[8 << 10, 64 << 10, 128 << 20])
def split_size(spark, request):
    with settings(spark, spark__sql__files__maxPartitionBytes=request.param, spark__sql__files__openCostInBytes=1):
        yield request.param


def test_one_meaning_of_lines_at_any_size(spark, tmp_path, limit, split_size):
    """A late header, indented comments, and headers and type rows repeated among the data."""
    rows = [f"2021-10-01 00:{i % 60:02d}\tPST\t{i}\tP" for i in range(1500)]
    text = values("01", "1_00010", rows)
    late = "# c\n  # indented\n" * 6000 + text + "  # behind\n" + text + "\n   \n" + text
    put(tmp_path, a=late, b="#\n \n", c=values("02", "2_00010", ["2021-10-01\tPST\t7\tP"]))
    long = observations.long_observations(scan(spark, str(tmp_path), whole_file_limit=limit))
    got = long.groupBy("site_no").agg(F.count("*"), F.sum("value")).collect()
    assert sorted(map(tuple, got)) == [("01", 4500, 3.0 * sum(range(1500))), ("02", 1, 7.0)]


def test_one_large_file_is_no_hot_key(spark, tmp_path, monkeypatch):
    """Headers too large to broadcast: a file's lines meet its header in many tasks, without adaptive execution."""
    rows = [f"2021-10-01 00:{i % 60:02d}\tPST\t{i}\tP" for i in range(6000)]
    put(tmp_path, large=values("01", "1_00010", rows), small=values("02", "2_00010", rows[:90]))
    monkeypatch.setattr(rdb, "BROADCAST_LIMIT", 0)
    monkeypatch.setattr(rdb, "PART_BYTES", 8 << 10)
    with settings(
        spark, spark__sql__files__maxPartitionBytes=8 << 10, spark__sql__files__openCostInBytes=1,
        spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold=-1,
        spark__sql__shuffle__partitions=16,
    ):
        text = scan(spark, str(tmp_path), whole_file_limit=0)
        assert not text.broadcast_heads
        long = observations.long_observations(text)
        met = long.groupBy("site_no", F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert sum(r.n for r in met) == 6090
    large = [r.n for r in met if r.site_no == "01"]
    assert len(large) > 8 and max(large) < 6000 / 3


def test_tasks_read_headers_and_no_more(spark, tmp_path):
    """A header's task stops behind the type row, however long the comments before it and the data after."""
    rows = [f"2021-10-01 00:{i % 60:02d}\tPST\t{i}\tP" for i in range(3000)]
    put(tmp_path, a="# c\n" * 500 + values("01", "1_00010", rows), b=values("02", "2_00010", rows), c="# none\n")
    text = scan(spark, str(tmp_path), whole_file_limit=0)
    kept = {r.file.rsplit("/")[-1]: r["count"] for r in text.head_lines.groupBy("file").count().collect()}
    assert kept == {"a.rdb": 500 + len(values("01", "1_00010", []).splitlines()), "b.rdb": len(values("02", "2_00010", []).splitlines()), "c.rdb": 1}

    class Batches:
        asked = 0

        def __iter__(self):
            for start in range(0, 6400, 64):
                self.asked += 1
                lines = ["# c"] * 64 if start < 128 else ["k\tv", "5s\t5n"] + ["a\t1"] * 62
                yield pa.RecordBatch.from_pydict({"file": ["f"] * 64, "parts": [1] * 64, "value": lines})

    batches = Batches()
    assert sum(b.num_rows for b in rdb._leading_lines(iter(batches))) == 130
    assert batches.asked == 3


def test_large_ids_stay_text(spark, tmp_path):
    rows = "".join(f"AG\t{i:08d}\n" for i in range(50_000))
    df = read_rdb(spark, put(tmp_path, a=f"agency_cd\tsite_no\n5s\t15s\n{rows}"))
    assert df.where("site_no = '00000017'").count() == 1


def test_whole_files_are_read_without_shuffle(spark, tmp_path):
    put(tmp_path, a=values("01", "1_00010", ["2021-10-01\tPST\t1\tP"]))
    plan = observations.long_observations(scan(spark, str(tmp_path)))._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_window_bounds(spark):
    df = spark.sql(
        "select cast(c as timestamp_ntz) datetime from values ('2021-10-15 00:00'), ('2021-10-15 00:15'), ('2021-10-01') t(c)"
    )
    count = lambda *bounds: observations.in_window(df, *bounds).count()
    assert count("2021-10-01", "2021-10-15") == 2
    assert count("2021-10-15", "") == 2
    assert count(None, "2021-10-14") == 1
    assert count("", None) == 3
    assert count(datetime(2021, 10, 15, 0, 15), "2021-10-16") == 1


@pytest.mark.parametrize(
    "token, value",
    [("1", 1.0), (" -2.5 ", -2.5), ("+.5", 0.5), ("3.", 3.0), ("1e5", 1e5), ("1.E-2", 0.01),
     ("007", 7.0), ("1d", None), ("1f", None), ("1D", None), ("0x1p3", None), ("0X1P3", None),
     ("inf", None), ("-Infinity", None), ("NaN", None), (".", None), ("-", None), ("1,000", None),
     ("1_0", None), ("1 2", None), ("1/2", None), ("Ice", None), ("", None), ("\u0001 5", None),
     ("5\u0001", None), ("\u0661", None), ("1e", None), ("--1", None)],
)
def test_numbers(spark, token, value):
    df = spark.createDataFrame([(token,)], "c string").select(number_cell(F.col("c")))
    assert df.first()[0] == value
