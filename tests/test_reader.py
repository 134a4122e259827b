"""The whole path on addresses of local files: fetch, land, store, refresh, read."""

from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from hydroframe.operators.observations import long_observations, moments
from hydroframe.operators.parameters import parameter_table
from hydroframe.plans.reader import OBSERVATIONS, STATIONS, StationReader, as_wide
from hydroframe.operators.upsert import parts_of, stacked_parts
from hydroframe.plans import store as store_module
from hydroframe.plans.store import Dataset, Store
from hydroframe.sources import service
from hydroframe.sources.html import SITE_TYPE_COLUMNS

DAY = datetime(2021, 11, 3, 10)


class Service:
    """Answers are files named like the query part of a request."""

    def __init__(self, folder):
        self.folder = folder
        self.url = f"file://{folder}"
        for part in ("site", "iv"):
            (folder / part).mkdir()

    def stations(self, state, *rows):
        body = "# list\nagency_cd\tsite_no\tstation_nm\n5s\t15s\t50s\n" + "".join(f"AG\t{r}\n" for r in rows)
        (self.folder / "site" / f"?format=rdb,1.0&stateCd={state}&siteStatus=all").write_text(body)

    def catalog(self, site, *rows):
        body = "site_no\tbegin_date\tend_date\n15s\t20d\t20d\n" + "".join(f"{site}\t{r}\n" for r in rows)
        name = f"?format=rdb,1.0&sites={site}&seriesCatalogOutput=true&siteStatus=all"
        (self.folder / "site" / name).write_text(body)

    def values(self, site, period, *rows, series="16223_00095"):
        body = "# only a comment\n"
        if rows:
            body = (
                "#    TS_ID       Parameter Description\n"
                f"#    {series[:5]}       {series[-5:]}     Specific conductance\n#\n"
                f"agency_cd\tsite_no\tdatetime\ttz_cd\t{series}\t{series}_cd\n5s\t15s\t20d\t6s\t14n\t10s\n"
            )
            body += "".join(f"AG\t{site}\t{r}\n" for r in rows)
        (self.folder / "iv" / f"?format=rdb,1.0&sites={site}{period}&siteStatus=all").write_text(body)


@pytest.fixture
def answers(tmp_path):
    return Service(tmp_path_factory_dir(tmp_path, "service"))


def tmp_path_factory_dir(base, name):
    folder = base / name
    folder.mkdir()
    return folder


@pytest.fixture
def reader(spark, answers, tmp_path):
    return StationReader(answers.url, Store(spark, str(tmp_path / "store"), buckets=8), tasks=2)


def cells(df):
    return {(r.site_no, r.datetime): (r.value, r.qualifier) for r in df.collect()}


def test_stations_of_several_states(reader, answers):
    answers.stations("ca", "01455780\tSTRAIT A BENICIA", "11455781\tWELL #3")
    answers.stations("nv", "02000001\tCREEK")
    both = reader.read_stations_for_state(["ca", "nv"], DAY)
    assert {(r.state, r.site_no) for r in both.collect()} == {
        ("ca", "01455780"), ("ca", "11455781"), ("nv", "02000001"),
    }
    one = both.where("site_no = '01455780'").collect()
    assert len(one) == 1 and "BENICIA" in one[0].station_nm

    # within a day the stored list is used, after it the list is replaced, per state
    answers.stations("ca", "01455780\tRENAMED")
    kept = reader.read_stations_for_state("ca", DAY.replace(hour=20))
    assert kept.where("station_nm = 'RENAMED'").count() == 0
    fresh = reader.read_stations_for_state("ca", datetime(2021, 11, 5))
    assert [r.station_nm for r in fresh.collect()] == ["RENAMED"]
    assert reader.read_stations_for_state("nv", DAY).count() == 1
    assert reader.store.superseded(STATIONS).count() > 0


def test_history_is_refreshed_from_the_last_day(reader, answers):
    full = "&startDT=1900-01-01"
    answers.values("01", full, "2021-09-30 00:00\tPST\t1\tP", "2021-10-02 00:00\tPST\t2\tP",
                   "2021-10-02 00:15\tPST\t3\tP")
    answers.values("02", full, "2021-10-01 00:00\tPST\t9\tP", series="77777_00010")
    answers.values("03", full)

    window = reader.read_station_data(["01", "02", "03"], "2021-10-01", "2021-10-02", DAY)
    assert cells(window) == {
        ("01", datetime(2021, 10, 2)): (2.0, "P"), ("02", datetime(2021, 10, 1)): (9.0, "P"),
    }
    # the whole history was stored
    assert reader.store.read(OBSERVATIONS).count() == 4
    marks = {r.site_no: r.high_water for r in reader.store.marks(OBSERVATIONS).collect()}
    assert marks == {"01": datetime(2021, 10, 2, 0, 15), "02": datetime(2021, 10, 1), "03": None}

    # an hour later: from the last day on; new nulls keep old cells, old rows stay;
    # a site without rows is asked from the start again
    answers.values("01", "&startDT=2021-10-02", "2021-10-02 00:00\tPST\t20\t", "2021-10-02 00:15\tPST\t\tA",
                   "2021-11-01 00:00\tPDT\t4\tA")
    answers.values("02", "&startDT=2021-10-01")
    answers.values("03", full, "2021-10-05 00:00\tPST\tIce\tP")
    later = DAY.replace(hour=12)
    rows = reader.read_station_data(["01", "02", "03"], now=later)
    assert cells(rows) == {
        ("01", datetime(2021, 9, 30)): (1.0, "P"),
        ("01", datetime(2021, 10, 2)): (20.0, "P"),
        ("01", datetime(2021, 10, 2, 0, 15)): (3.0, "A"),
        ("01", datetime(2021, 11, 1)): (4.0, "A"),
        ("02", datetime(2021, 10, 1)): (9.0, "P"),
        ("03", datetime(2021, 10, 5)): (None, "P"),
    }
    assert {r.fetched_at for r in reader.store.marks(OBSERVATIONS).collect()} == {later}

    # fresh: nothing is fetched, the answers may be gone
    for path in (answers.folder / "iv").iterdir():
        path.write_text("broken")
    again = reader.read_station_data("01", "2021-10-02", "2021-10-31", later)
    assert again.count() == 2

    wide = as_wide(rows.where("site_no = '01'"))
    assert wide.columns == ["site_no", "datetime", "tz_cd", "agency_cd", "16223_00095", "16223_00095_cd"]
    assert {r.agency_cd for r in wide.collect()} == {"AG"}
    assert wide.count() == 4


def test_a_window_opens_its_months_and_bucket_only(reader, answers):
    answers.values("01", "&startDT=1900-01-01", *(f"2021-{m:02d}-05\tPST\t{m}\tP" for m in range(1, 13)))
    answers.values("02", "&startDT=1900-01-01", "2021-05-05\tPST\t1\tP")
    reader.read_station_data(["01", "02"], now=DAY)
    files = reader.read_station_data("01", "2021-05-01", "2021-06-30", DAY).inputFiles()
    assert {f.split("period=")[1][:7] for f in files} == {"2021-05", "2021-06"}
    assert len({f.split("bucket=")[1].split("/")[0] for f in files}) == 1


def test_only_touched_partitions_are_rewritten(reader, answers):
    answers.values("01", "&startDT=1900-01-01", "2020-01-01\tPST\t1\tP", "2021-10-02\tPST\t2\tP")
    reader.read_station_data("01", now=DAY)
    before = {f for f in reader.store.read(OBSERVATIONS).inputFiles()}
    answers.values("01", "&startDT=2021-10-02", "2021-10-02\tPST\t3\tP")
    reader.read_station_data("01", now=datetime(2021, 11, 4))
    after = {f for f in reader.store.read(OBSERVATIONS).inputFiles()}
    assert {f for f in before if "period=2020-01" in f} == {f for f in after if "period=2020-01" in f}
    assert not {f for f in before if "period=2021-10" in f} & after
    assert [r.value for r in reader.store.read(OBSERVATIONS).orderBy("datetime").collect()] == [1.0, 3.0]


def test_autumn_hour_keeps_both_zones(reader, answers):
    answers.values("01", "&startDT=1900-01-01", "2021-11-07 01:30\tPDT\t1\tP", "2021-11-07 01:30\tPST\t2\tP",
                   "2021-11-07 01:30\tPST\t3\tP")
    rows = reader.read_station_data("01", now=DAY).collect()
    assert sorted((r.tz_cd, r.value) for r in rows) == [("PDT", 1.0), ("PST", 3.0)]


def test_parameters_catalog_and_codes(reader, answers, tmp_path):
    answers.values("01", "", "2021-10-01\tPST\t1\tP")
    answers.values("02", "")
    got = reader.read_station_parameters(["01", "02"], DAY).collect()
    assert [(r.site_no, r.TS_ID, r.Parameter, r.Description) for r in got] == [
        ("01", "16223", "00095", "Specific conductance")
    ]
    answers.catalog("01", "1997\t2021-10-01", "1996-05\t2020-01-01")
    info = reader.read_station_detailed_info("01", DAY)
    assert info.columns == ["site_no", "begin_date", "end_date"]
    span = info.agg(F.min("begin_date"), F.max("end_date")).first()
    assert tuple(span) == (datetime(1996, 5, 1), datetime(2021, 10, 1))
    head = "".join(f"<th>{c}</th>" for c in SITE_TYPE_COLUMNS)
    page = tmp_path / "codes.html"
    page.write_text(f"<table><tr>{head}</tr><tr><td>ST</td><td>10</td></tr></table>")
    codes = reader.read_site_type_codes(f"file://{page}", DAY).collect()
    assert [(r["Site Tp Cd"], r["Site Tp Srt Nu"]) for r in codes] == [("ST", 10)]


def test_full_and_yearly_reads(reader, answers):
    answers.values("01", "&startDT=1900-01-01", "2019-05-01\tPST\t1\tP", "2021-10-02\tPST\t2\tP")
    assert reader.read_entire_station_data_for("01").count() == 2
    for year, day in ((2019, "05-01"), (2020, None), (2021, "10-02")):
        rows = [f"{year}-{day}\tPST\t1\tP", f"{year}-01-01\tPST\t0\tP"] if day else []
        answers.values("01", f"&startDT={year}-01-01&endDT={year}-12-31", *rows)
    got = reader.read_station_data_by_year("01", "2021-10-02", "2019-02-01", DAY)
    assert sorted(r.datetime for r in got.collect()) == [
        datetime(2019, 5, 1), datetime(2021, 1, 1), datetime(2021, 10, 2),
    ]


def test_gained_columns(spark, reader, answers):
    answers.stations("ca", "01\tA")
    reader.read_stations_for_state("ca", DAY)
    (answers.folder / "site" / "?format=rdb,1.0&stateCd=nv&siteStatus=all").write_text(
        "site_no\talt_va\n15s\t8n\n02\t7\n"
    )
    rows = reader.read_stations_for_state(["ca", "nv"], DAY).collect()
    want = [("01", "A", None), ("02", None, 7.0)]
    assert sorted((r.site_no, r.station_nm, r.alt_va) for r in rows) == want
    # the same with both lists in one fetch
    together = StationReader(answers.url, Store(spark, reader.store.root + "2"))
    rows = together.read_stations_for_state(["ca", "nv"], DAY).collect()
    assert sorted((r.site_no, r.station_nm, r.alt_va) for r in rows) == want


def test_data_source(spark, answers):
    answers.stations("ca", "01\tA")
    answers.stations("nv", "02\tB")
    service.register(spark)
    urls = "\n".join(
        f"{answers.url}/site/?format=rdb,1.0&stateCd={s}&siteStatus=all" for s in ("ca", "nv")
    )
    df = spark.read.format("station_service").option("urls", urls).load()
    assert df.rdd.getNumPartitions() == 2
    rows = service.RdbText(documents=df).table({"site_no": "15s", "station_nm": "50s"})
    assert sorted(map(tuple, rows.collect())) == [("01", "A"), ("02", "B")]


def test_a_response_in_pieces(spark, answers, tmp_path, monkeypatch):
    """Pieces end with lines, whatever their size, and carry the header themselves."""
    rows = [f"2021-10-01 00:{i % 60:02d}\tPST\t{i}\tP" for i in range(500)]
    answers.values("01", "", *rows)
    url = answers.url + "/iv/?format=rdb,1.0&sites=01&siteStatus=all"
    body = next((answers.folder / "iv").iterdir())
    body.write_text(" # indented\n\n" + body.read_text())
    for size in (1, 700, 1 << 20):
        monkeypatch.setattr(service, "PIECE", size)
        pieces = list(service.response_pieces(url))
        frame = spark.createDataFrame([("f", n, v) for n, v in pieces], service.TEXT_SCHEMA)
        text = service.landed(frame, str(tmp_path / f"landed{size}"))
        got = long_observations(text).orderBy("block", "line").collect()
        assert [r.value for r in got] == [float(i) for i in range(500)]
        assert [r.Description for r in parameter_table(text).collect()] == ["Specific conductance"]
        assert "Join" not in long_observations(text)._jdf.queryExecution().toString()


BOUNDS = [None, "", "2021", "2021-9-1", "2021-10-05 12:00", "2021-9-30 23:59:59", datetime(2021, 9, 5, 6), "2022-1-1"]


def test_stored_windows_lose_no_row(spark, reader, answers):
    times = ["2021-01-01 00:00", "2021-09-01 00:00", "2021-09-05 06:00", "2021-09-30 23:59:59", "2021-10-05 12:00",
             "2021-12-31 00:00", "2022-01-01 00:00", "2020-02-29 01:00"]
    answers.values("01", "&startDT=1900-01-01", *(f"{t}\tPST\t{n}\tP" for n, t in enumerate(times)))
    every = reader.read_station_data("01", now=DAY)
    kept = [(r.datetime, r.value) for r in every.collect()]
    for start in BOUNDS:
        for end in BOUNDS:
            low, high = moments(spark, start, end)
            want = sorted((t, v) for t, v in kept if (low is None or t >= low) and (high is None or t <= high))
            stored = reader.store.read(OBSERVATIONS, start=start, end=end)
            assert sorted((r.datetime, r.value) for r in stored.collect()) == want, (start, end)


def test_unreadable_times_and_rejected_lines_are_kept(reader, answers):
    full = "&startDT=1900-01-01"
    answers.values("01", full, "soon\tPST\t1\tP", "later\tPST\t2\tP", "2021-13-99\tPST\t3\tP", "2021-10-01\tPST\t4\tP",
                   "2021-10-02\tPST\t5\tP\tsurplus")
    assert [r.value for r in reader.read_station_data("01", now=DAY).collect()] == [4.0]
    aside = reader.unplaced("observations").collect()
    assert sorted((r.raw_time, r.raw) for r in aside) == [("2021-13-99", "3"), ("later", "2"), ("soon", "1")]
    assert [r.value.split("\t")[-1] for r in reader.rejected("observations").collect()] == ["surplus"]
    assert reader.rejected("stations") is None


def test_yearly_dates_in_any_form_and_order(reader, answers):
    for year in (2020, 2021):
        rows = [f"{year}-09-01\tPST\t1\tP", f"{year}-10-15\tPST\t2\tP"]
        answers.values("01", f"&startDT={year}-01-01&endDT={year}-12-31", *rows)
    for dates in (("2021-9-1", "2020-10-15"), ("2020-10-15", datetime(2021, 9, 1))):
        got = reader.read_station_data_by_year("01", *dates, DAY)
        assert sorted(r.datetime for r in got.collect()) == [datetime(2020, 10, 15), datetime(2021, 9, 1)]


def test_every_column_of_a_station_is_kept(reader, answers):
    """Statistics in names, other columns as attributes, repeated rows: the last one counts."""
    body = (
        "agency_cd\tsite_no\tdatetime\ttz_cd\t1_00010_00003\t1_00010_00003_cd\t2_00060\t2_00060_cd\tnote\n"
        "5s\t15s\t20d\t6s\t14n\t10s\t14n\t10s\t20s\n"
        "AG\t01\t2021-10-01\tPST\t1\tP\t5\tA\t\nAG\t01\t2021-10-01\tPST\t2\tA\t6\tP\tclear\n"
    )
    (answers.folder / "iv" / "?format=rdb,1.0&sites=01&startDT=1900-01-01&siteStatus=all").write_text(body)
    long = reader.read_entire_station_data_for("01")
    assert {(r.ts_id, r.parameter_cd, r.statistic_cd) for r in long.collect()} == {
        ("1", "00010", "00003"), ("2", "00060", None),
    }
    wide = as_wide(long)
    assert wide.columns[3:] == ["agency_cd", "note", "1_00010_00003", "1_00010_00003_cd", "2_00060", "2_00060_cd"]
    assert tuple(wide.first())[3:] == ("AG", "clear", 2.0, "A", 6.0, "P")
    assert as_wide(long, ["2_00060"], []).columns[3:] == ["2_00060", "2_00060_cd"]
    stored = reader.read_station_data("01", now=DAY).collect()
    assert sorted((r.ts_id, r.value, r.attributes["note"]) for r in stored) == [("1", 2.0, "clear"), ("2", 6.0, "clear")]


def test_a_writer_that_died_does_not_block(reader, answers):
    answers.stations("ca", "01\tA")
    reader.read_stations_for_state("ca", DAY)
    commits = Path(reader.store.root) / "stations" / "commits"
    for name in ("version=2", "2-abc", "9-def", "2"):
        (commits / name).mkdir()
    (commits / "2-abc" / "part-0.parquet").write_text("half a file")
    answers.stations("ca", "01\tB")
    fresh = reader.read_stations_for_state("ca", datetime(2021, 11, 5))
    assert [r.station_nm for r in fresh.collect()] == ["B"]
    again = reader.read_stations_for_state("ca", datetime(2021, 11, 9))
    assert [r.station_nm for r in again.collect()] == ["B"]


def test_the_newest_commit_is_found_without_opening_old_ones(reader, answers):
    answers.stations("ca", "01\tA")
    for day in (1, 3, 5):
        reader.read_stations_for_state("ca", datetime(2021, 11, day))
    commits = sorted((Path(reader.store.root) / "stations" / "commits").iterdir())
    for old in commits[:-1]:
        for file in old.glob("*.parquet"):
            file.write_text("gone")
    assert reader.store.read(STATIONS).count() == 1


def test_rows_of_a_file_are_sorted_by_key_and_time(reader, answers):
    rows = [f"2021-10-{d:02d}\tPST\t{d}\tP" for d in (9, 3, 27, 1, 14)]
    for site in ("03", "01", "02"):
        answers.values(site, "&startDT=1900-01-01", *rows)
    reader.read_station_data(["01", "02", "03"], now=DAY)
    for file in reader.store.read(OBSERVATIONS).inputFiles():
        stored = [(r.site_no, r.datetime) for r in reader.spark.read.parquet(file).collect()]
        assert stored == sorted(stored)


def test_two_writers_cannot_commit_the_same_version(reader, answers):
    answers.stations("ca", "01\tA")
    reader.read_stations_for_state("ca", DAY)
    store = reader.store
    state = store._latest(STATIONS)
    with pytest.raises(Exception, match="(?i)already exists"):
        store._write_commit(STATIONS, state, "x")


def test_a_list_of_frames_is_stored_by_part(spark, tmp_path):
    store = Store(spark, str(tmp_path / "parts"))
    calls = []

    @store.cached(Dataset("frames", key="name", ttl="1D"))
    def frames(todo):
        names = [r.name for r in todo.collect()]
        calls.append(names)
        a = spark.createDataFrame([(n, i) for n in names for i in (1, 2)], "name string, a int")
        b = spark.createDataFrame([(n, 3, "x") for n in names], "name string, a int, b string")
        return stacked_parts([a, b])

    keys = spark.createDataFrame([("k",)], "name string")
    now = F.lit(DAY.isoformat(sep=" ")).cast("timestamp_ntz")
    for _ in range(2):
        first, second = parts_of(frames(keys, now), 2)
        assert sorted(r.a for r in first.collect()) == [1, 2]
        assert [(r.a, r.b) for r in second.collect()] == [(3, "x")]
    assert calls == [["k"]]


def test_a_hot_folder_is_written_by_several_tasks(spark, tmp_path):
    store = Store(spark, str(tmp_path / "hot"))
    rows = spark.range(60_000).select(
        F.lit("01").alias("site_no"),
        F.lit("1").alias("ts_id"),
        F.lit("00010").alias("parameter_cd"),
        F.lit(None).cast("string").alias("statistic_cd"),
        (F.lit("2021-10-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("double")))
        .alias("datetime"),
        F.lit("PST").alias("tz_cd"),
        F.col("id").cast("double").alias("value"),
        F.col("id").cast("string").alias("raw"),
        F.lit("P").alias("qualifier"),
        F.lit("f").alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("id").alias("line"),
    )
    # A folder is cut along the tasks before it: keep those of the upsert apart.
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in small.items():
        spark.conf.set(name, value)
    try:
        store.commit(OBSERVATIONS, None, rows, F.lit("2021-11-03").cast("timestamp_ntz"))
    finally:
        for name in small:
            spark.conf.unset(name)
    stored = store.read(OBSERVATIONS)
    assert stored.count() == 60_000
    files = stored.inputFiles()
    assert len({f.rsplit("/", 1)[0] for f in files}) == 1 and len(files) > 3


def test_marks_are_written_as_they_change(spark, tmp_path, monkeypatch):
    """A refresh writes the marks of its keys; lists of changes are folded when they are many."""
    monkeypatch.setattr(store_module, "MOST_MARKS", 3)
    monkeypatch.setattr(store_module, "FOLDED_MARKS", 2)
    store = Store(spark, str(tmp_path), buckets=1)
    dataset = Dataset("d", key="k", ttl="1D")
    moments_of = {}
    lists = []
    for n, keys in enumerate([[f"k{i}" for i in range(50)], ["k1"], ["k2"], ["k1"], ["k3"], ["new"]]):
        rows = spark.createDataFrame([(k, n) for k in keys], "k string, v int")
        now = datetime(2021, 1, n + 1)
        store.commit(dataset, rows.select("k"), rows, F.lit(now.isoformat(" ")).cast("timestamp_ntz"))
        moments_of |= dict.fromkeys(keys, now)
        lists.append([count for _, count in store._latest(dataset).marks])
    assert lists == [[50], [50, 1], [50, 1, 1], [50, 2], [50, 2, 1], [50, 4]]
    assert {r.k: r.fetched_at for r in store.marks(dataset).collect()} == moments_of


def test_a_failed_request_asks_nobody_else_again(spark, tmp_path):
    """Requests that fail are asked again alone; a response that broke off leaves no piece behind."""
    text = "# c\nk\tv\n5s\t5n\n" + "".join(f"{{name}}\t{i}\n" for i in range(4))
    calls = tmp_path / "calls"
    calls.mkdir()

    def answer(url):
        """Fails for `c` twice, the first time behind its first piece; tells each call by a file."""
        asked = len(list(calls.glob(f"{url}-*")))
        (calls / f"{url}-{asked}").touch()
        if url == "c" and asked == 0:
            yield 0, text.format(name="broken")
        if url == "c" and asked < 2:
            raise OSError("gone")
        yield 0, text.format(name=url)

    plan = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")

    def count():
        return sorted(path.name for path in calls.iterdir())

    folder = str(tmp_path / "landed")
    with pytest.raises(OSError, match="c: gone"):
        service.land_requests(plan, folder, tasks=2, rounds=1, read=answer)
    assert count() == ["a-0", "b-0", "c-0", "d-0"]
    got = service.land_requests(plan, folder, tasks=2, read=answer).table()
    assert count() == ["a-0", "b-0", "c-0", "c-1", "c-2", "d-0"]
    assert sorted((r.k, int(r.v)) for r in got.collect()) == [(k, v) for k in "abcd" for v in range(4)]


def test_text_is_parsed_once(spark, tmp_path):
    """Rows of all kinds come from one table; the store reads that and not the text."""
    text = "site_no\tdatetime\ttz_cd\t1_00010\t1_00010_cd\n15s\t20d\t6s\t14n\t10s\n"
    text += "1\t2021-01-01\tPST\t5\tP\n1\tsoon\tPST\t6\tP\n1\t2021-01-02\tPST\t7\tP\tmore\n"
    pieces = spark.createDataFrame([("f", 0, text)], "file string, block long, value string")
    store = Store(spark, str(tmp_path / "store"))
    rows = store.routed("d", service.landed(pieces, str(tmp_path / "text")))
    assert all("/staged/d/" in name for name in rows.inputFiles())
    assert [(r.site_no, r.value) for r in rows.collect()] == [("1", 5.0)]
    assert [(r.raw_time, r.value) for r in store.aside("unplaced-d").collect()] == [("soon", 6.0)]
    assert [r.value.rsplit("\t", 1)[1] for r in store.aside("rejected-d").collect()] == ["more"]
