"""The landing stream gives the same table as one batch."""

import os

import pytest
from pyspark.sql import functions as F

from hydroframe.operators.observations import long_observations
from hydroframe.plans.reader import OBSERVATIONS
from hydroframe.plans.store import Store
from hydroframe.sources.rdb import scan
from hydroframe.streaming.landing import stream_upsert


def file_of(folder, name, site, series, *rows):
    (folder / name).write_text(
        f"# c\nsite_no\tdatetime\ttz_cd\t{series}\t{series}_cd\n15s\t20d\t6s\t14n\t10s\n"
        + "".join(f"{site}\t{r}\n" for r in rows)
    )


def rows_of(store):
    return sorted(map(tuple, store.read(OBSERVATIONS).collect()), key=repr)


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    now = F.lit("2021-11-03").cast("timestamp_ntz")
    streamed = Store(spark, str(tmp_path / "streamed"))

    def run():
        query = stream_upsert(
            spark, str(landing), streamed, OBSERVATIONS, now, str(tmp_path / "state"), max_files=1
        )
        query.awaitTermination()
        return query

    file_of(landing, "a.rdb", "01", "11_00095", "2021-10-01\tPST\t1\tP", "2021-10-02\tPST\t2\tP")
    file_of(landing, "b.rdb", "02", "22_00010", "2021-10-01\tPST\t5\tP")
    (landing / "c.rdb").write_text("# only a comment\n")
    run()
    assert len(rows_of(streamed)) == 3
    file_of(landing, "d.rdb", "01", "11_00095", "2021-10-02\tPST\t20\t", "2021-10-03\tPST\t3\tP")
    second = run()
    assert sum(p["numInputRows"] for p in second.recentProgress) == 1
    run()

    batch = Store(spark, str(tmp_path / "batch"))
    first = scan(spark, [str(landing / n) for n in ("a.rdb", "b.rdb", "c.rdb")])
    batch.commit(OBSERVATIONS, None, long_observations(first).drop("raw_time"), now)
    second_file = long_observations(scan(spark, str(landing / "d.rdb")))
    batch.commit(OBSERVATIONS, None, second_file.drop("raw_time"), now)
    assert rows_of(streamed) == rows_of(batch)
    marks = {r.site_no: str(r.high_water) for r in streamed.marks(OBSERVATIONS).collect()}
    assert marks == {"01": "2021-10-03 00:00:00", "02": "2021-10-01 00:00:00"}


@pytest.mark.parametrize("max_files", [1, 10])
def test_the_result_does_not_depend_on_the_batch_size(spark, tmp_path, max_files):
    """Overlapping files of one site: the later one wins, whatever the names and batches."""
    landing = tmp_path / "landing"
    landing.mkdir()
    names = ["b.rdb", "a [1].rdb", "c {x}*.rdb", "a.rdb"]
    for n, name in enumerate(names):
        file_of(landing, name, "01", "11_00095", f"2021-10-01\tPST\t{n}\tP", f"2021-10-0{n + 2}\tPST\t{n}\tP")
        os.utime(landing / name, (1_600_000_000 + 60 * n,) * 2)
    file_of(landing, "z.rdb", "02", "11_00095", "soon\tPST\t1\tP", "2021-10-01\tPST\t8\tP")
    store = Store(spark, str(tmp_path / "store"))
    now = F.lit("2021-11-03").cast("timestamp_ntz")
    stream_upsert(
        spark, str(landing), store, OBSERVATIONS, now, str(tmp_path / "state"), max_files=max_files
    ).awaitTermination()
    got = sorted((r.site_no, r.datetime.day, r.value) for r in store.read(OBSERVATIONS).collect())
    assert got == [("01", 1, 3.0), ("01", 2, 0.0), ("01", 3, 1.0), ("01", 4, 2.0), ("01", 5, 3.0), ("02", 1, 8.0)]
    assert [r.raw_time for r in store.aside("unplaced-observations").collect()] == ["soon"]


NOW = "2021-11-03"


def landed_in_runs(spark, tmp_path, runs, max_files=10):
    """The store after files (name, modification time, rows) arrived in several runs."""
    name = "-".join(str(len(run)) for run in runs) + "".join(f[0][0] for run in runs for f in run)
    folder = tmp_path / name
    (folder / "landing").mkdir(parents=True)
    store = Store(spark, str(folder / "store"), buckets=2)
    for run in runs:
        for file, time, *rows in run:
            file_of(folder / "landing", file, "01", "11_00095", *rows)
            os.utime(folder / "landing" / file, (time, time))
        stream_upsert(
            spark, str(folder / "landing"), store, OBSERVATIONS, F.lit(NOW).cast("timestamp_ntz"),
            str(folder / "state"), max_files=max_files,
        ).awaitTermination()
    return store


DAY = 86_400
T0 = 1_600_000_000
A = ("a.rdb", T0, "2021-10-01\tPST\t1\tP", "2021-10-02\tPST\t1\tP")
B = ("b.rdb", T0 - 30 * DAY, "2021-10-01\tPST\t2\t", "2021-10-03\tPST\t2\tP")
C = ("c.rdb", T0 + 3600, "2021-10-01\tPST\tIce\tA", "2021-10-02\tPST\t\tR")
D = ("d.rdb", T0, "2021-10-02\tPST\t4\tP", "2021-10-04\tPST\t4\tP")
WON = [(1, None, "Ice", "A"), (2, 4.0, "4", "R"), (3, 2.0, "2", "P"), (4, 4.0, "4", "P")]


@pytest.mark.parametrize(
    "runs", [[[A, B, C, D]], [[D], [C], [A, B]], [[B, A], [D, C]]]
)
def test_the_result_does_not_depend_on_the_runs(spark, tmp_path, runs):
    """Of any cell the later file's counts, by its time, then by its name; a null is no cell."""
    store = landed_in_runs(spark, tmp_path, runs)
    got = sorted((r.datetime.day, r.value, r.raw, r.qualifier) for r in store.read(OBSERVATIONS).collect())
    assert got == WON
    assert "written" not in store.read(OBSERVATIONS).columns


def test_files_of_any_age_land_once(spark, tmp_path):
    old = [(f"old{n}.rdb", T0 - n * DAY, f"2021-11-01\tPST\t{n}\tP") for n in (900, 30, 8)]
    again = ("a.rdb", T0 + 60, "2021-10-01\tPST\t7\tP")
    store = landed_in_runs(spark, tmp_path, [[A], old, [again], []])
    got = sorted((r.datetime.month, r.datetime.day, r.value) for r in store.read(OBSERVATIONS).collect())
    assert got == [(10, 1, 7.0), (10, 2, 1.0), (11, 1, 8.0)]
    journal = spark.read.parquet(str(next(tmp_path.glob("*/state/journal"))))
    assert sorted(r.path.rsplit("/")[-1] for r in journal.collect()) == ["a.rdb", "a.rdb", "old30.rdb", "old8.rdb", "old900.rdb"]


def test_a_refresh_without_writers_counts_by_its_time(spark, tmp_path):
    store = landed_in_runs(spark, tmp_path, [[A]])
    (tmp_path / "fetched").mkdir()
    file_of(tmp_path / "fetched", "0", "01", "11_00095", "2021-10-01\tPST\t5\tP")
    rows = long_observations(scan(spark, str(tmp_path / "fetched"))).drop("raw_time")

    def first_value(moment):
        store.commit(OBSERVATIONS, None, rows, F.lit(moment).cast("timestamp_ntz"))
        return store.read(OBSERVATIONS).where("day(datetime) = 1").first().value

    assert first_value("2000-01-01") == 1.0
    assert first_value(NOW) == 5.0
