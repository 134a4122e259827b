"""Station tables that know how fresh they are and are refreshed in place of a cache.

Layout of one dataset under `root/<dataset>`:

    data/gen=<id>/period=<p>/bucket=<b>/*.parquet   rows, never changed once written
    marks/<id>                                      key, fetched_at, high_water: what a refresh changed
    commits/<n>-<id>                                which generation holds each (period, bucket)
    aside/<id>                                      rows that cannot be stored, as fetched

Under `root/staged` lie parsed rows by kind, until they are removed as what is superseded is.

A refresh rewrites only the (period, bucket) partitions its rows fall into and then
commits a new version; readers keep the version they started with. Buckets are hashes
of the key, so that a read by key opens one bucket however many keys there are. What
falls into one partition is written by several tasks when it is large.

Marks of all keys are the fold of the changes a commit lists. Its newest changes become one
list when they are many, and meet older, larger ones only once they are as many as those:
what is written follows the keys that were refreshed, not the keys there are.

A commit is a folder of its own, and counts once its writer has marked it complete. The
newest is told by the folders' names; what a writer left that died is never looked at.
"""

from __future__ import annotations

import functools
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hydroframe.operators.observations import (
    PLACED,
    REJECTED,
    TIMELESS,
    in_window,
    moments,
    routed_observations,
)
from hydroframe.operators.refresh import freshness, refetch_since
from hydroframe.operators.upsert import WRITTEN, stamped, upsert_agg, upsert_stamped
from hydroframe.sources.rdb import RdbText

PLACE = ["period", "bucket"]
PLACE_FIELDS = [StructField("period", StringType()), StructField("bucket", LongType())]
MANIFEST_SCHEMA = "period string, bucket bigint, gen string"
# A commit holds its manifest and one row with the last columns.
COMMIT_SCHEMA = f"{MANIFEST_SCHEMA}, marks string, fields string, buckets int"
Bound = str | datetime | None
ALL_TIMES = "all"
FEW_KEYS = 1000
# Lists of changed marks that a commit names at most, and how many of the newest become one.
MOST_MARKS, FOLDED_MARKS = 32, 16


@dataclass(frozen=True)
class Dataset:
    """What is stored: its key, its lifetime and how a refresh meets old rows.

    With `identity` columns a refresh is a cell-level upsert, see `upsert_agg` for
    `order` and `present`; without, it replaces all rows of the refreshed keys.
    With `stamp`, the columns `order` begins with, every cell keeps its last writer, and the
    later writer wins whichever refresh it came in; without, the later refresh wins.
    `time` splits the storage by `period`, too, a month unless a pattern says otherwise;
    the names a pattern gives must sort as the times do.
    """

    name: str
    key: str
    ttl: str
    identity: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    stamp: tuple[str, ...] = ()
    present: dict[str, str] = field(default_factory=dict)
    time: str | None = None
    period: str = "yyyy-MM"


# Which generation holds each (period, bucket). One entry per stored folder: its size is
# bounded by periods times buckets and grows neither with rows nor with keys.
Manifest = dict[tuple[str, int], str]


@dataclass(frozen=True)
class Version:
    """One committed state of a dataset.

    `marks` lists folders of changed marks, oldest first, each with its number of rows.
    """

    number: int
    manifest: Manifest
    marks: list[tuple[str, int]]
    fields: StructType
    buckets: int


@dataclass(frozen=True)
class Generation:
    """Rows just written, listed once."""

    rows: DataFrame
    manifest: Manifest


def _wider(old: StructType, new: StructType) -> StructType:
    """Fields of both; a dataset may gain columns but not change their types."""
    types = {f.name: f.dataType for f in old}
    for f in new:
        # Whether parts of a type may be null says nothing about what is stored.
        if types.setdefault(f.name, f.dataType).simpleString() != f.dataType.simpleString():
            raise ValueError(f"{f.name} is stored as {types[f.name]}, fetched as {f.dataType}")
    return StructType([StructField(name, kind) for name, kind in types.items()])


class Store:
    """Datasets under one folder that all executors share. One writer per dataset.

    `buckets` counts for datasets that are yet empty; a stored one keeps its number. A
    good number makes the newest period's folders some hundred MB each.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    # -- reading -----------------------------------------------------------------

    def read(
        self,
        dataset: Dataset,
        keys: DataFrame | None = None,
        start: Bound = None,
        end: Bound = None,
    ) -> DataFrame:
        """The committed rows of the closed window, opening only the buckets of `keys` and the
        periods asked for. Bounds are those of `in_window`: periods and condition come from
        the same moments."""
        version = self._latest(dataset)
        places = version.manifest.items()
        if dataset.time and (start or end):
            start, end = moments(self.spark, start, end)
            # Rows without a time lie under ALL_TIMES and are in no window.
            first, last = self._periods_of(dataset, start, end)
            places = [
                (p, gen)
                for p, gen in places
                if p[0] != ALL_TIMES and (first or p[0]) <= p[0] <= (last or p[0])
            ]
        if keys is not None:
            wanted = self._buckets_of(dataset, keys, version.buckets)
            places = [(p, gen) for p, gen in places if p[1] in wanted]
        rows = self._rows(dataset, version.fields, dict(places))
        if keys is not None:
            rows = self._of_keys(rows, keys, dataset.key)
        if dataset.time and (start or end):
            rows = in_window(rows, start, end, dataset.time)
        return rows.drop(*PLACE, WRITTEN)

    def marks(self, dataset: Dataset) -> DataFrame:
        """(key, fetched_at, high_water): one row per key ever fetched."""
        return self._folded(dataset, [path for path, _ in self._latest(dataset).marks])

    def status(self, dataset: Dataset, keys: DataFrame, now: Column) -> DataFrame:
        """Requested keys with `fetched_at`, `high_water` and whether they are stale."""
        return freshness(keys, self.marks(dataset), [dataset.key], dataset.ttl, now)

    def superseded(self, dataset: Dataset) -> DataFrame:
        """(period, bucket, gen): stored partitions the latest version no longer reads."""
        base = self._folder(dataset, "data")
        stored = self._generations(dataset, StructType([]), [base]).select(*PLACE, "gen")
        current = self._manifest_rows(self._latest(dataset).manifest)
        return stored.distinct().join(current, [*PLACE, "gen"], "left_anti")

    # -- writing -----------------------------------------------------------------

    def materialize(
        self,
        dataset: Dataset,
        keys: DataFrame,
        fetch: Callable[[DataFrame], DataFrame],
        now: Column,
        start: Bound = None,
        end: Bound = None,
    ) -> DataFrame:
        """Rows of the requested keys, after fetching those that are absent or stale.

        `fetch` gets (key, since) of the keys to fetch, `since` being the day of the
        last stored row or the start of history, and returns rows.
        """
        keys = keys.select(F.col(dataset.key).cast("string")).distinct()
        stale = self.status(dataset, keys, now).where("stale").select(dataset.key)
        if not stale.isEmpty():
            requests = refetch_since(stale, self.marks(dataset), [dataset.key])
            self.commit(dataset, stale, fetch(requests), now)
        return self.read(dataset, keys, start, end)

    def commit(
        self, dataset: Dataset, keys: DataFrame | None, rows: DataFrame, now: Column
    ) -> int:
        """Bring fetched rows of `keys` into the dataset; returns the new version.

        Without `keys` the keys of the rows count as fetched. The fetched rows are computed
        once, into a generation of their own. Partitions that held nothing before are
        committed as they are.
        """
        before = self._latest(dataset)
        dataset, rows = self._with_writers(dataset, rows, before.fields, now)
        incoming = self._placed(dataset, rows, before.buckets)
        if dataset.stamp:
            keys_of = [*dataset.identity, *PLACE]
            incoming = stamped(incoming, keys_of, list(dataset.order), list(dataset.stamp), dataset.present)
        elif dataset.identity:
            incoming = self._upserted(dataset, [incoming], dataset.order)
        incoming = incoming.drop(*dataset.order)
        fields = _wider(before.fields, StructType([f for f in incoming.schema if f.name not in PLACE]))
        arrived = self._written(dataset, incoming)
        new = arrived.manifest
        if keys is None:
            keys = arrived.rows.select(dataset.key)
        if dataset.identity:
            touched = before.manifest.keys() & new.keys()
        else:
            refreshed = self._buckets_of(dataset, keys, before.buckets)
            touched = {place for place in before.manifest if place[1] in refreshed}
        if touched:
            old = self._rows(dataset, fields, {p: before.manifest[p] for p in touched})
            if dataset.identity:
                meeting = self._rows(dataset, fields, {p: new[p] for p in touched})
                merged = self._upserted(dataset, [meeting, old])
            else:
                kept = old.join(keys, dataset.key, "left_anti")
                merged = kept.unionByName(arrived.rows, allowMissingColumns=True)
                new = {}
            new = new | self._written(dataset, merged).manifest
        untouched = {p: gen for p, gen in before.manifest.items() if p not in touched}
        marks = self._written_marks(dataset, before.marks, keys, arrived.rows, now)
        after = replace(before, number=before.number + 1, manifest=untouched | new, fields=fields)
        self._write_commit(dataset, after, marks)
        return after.number

    def cached(self, dataset: Dataset):
        """Decorator: a fetch function becomes one that answers from the store.

        The function takes (key, since) and returns rows; the result takes keys and the
        time of the run.
        """

        def wrap(fetch: Callable[[DataFrame], DataFrame]) -> Callable[..., DataFrame]:
            @functools.wraps(fetch)
            def read(keys: DataFrame, now: Column, **window: Bound) -> DataFrame:
                return self.materialize(dataset, keys, fetch, now, **window)

            return read

        return wrap

    def routed(self, name: str, text: RdbText) -> DataFrame:
        """The observations of `text` that have a time, for a dataset.

        The text is parsed once, into a table by kinds of rows; lines that fit no header and
        observations without a time are set aside from there.
        """
        folder = f"{self.root}/staged/{name}/{uuid.uuid4().hex}"
        long = routed_observations(text)
        long.write.partitionBy("kind").parquet(folder)
        staged = self.spark.read.schema(long.schema).parquet(folder)
        rejected = staged.where(F.col("kind") == REJECTED).select(
            "file", "block", "line", *text.carried, F.col("rejected").alias("value")
        )
        lost = staged.where(F.col("kind") == TIMELESS).drop("kind", "rejected")
        for kind, rows in (("rejected", rejected), ("unplaced", lost)):
            if not rows.isEmpty():
                self.set_aside(f"{kind}-{name}", rows)
        return staged.where(F.col("kind") == PLACED).drop("kind", "rejected", "raw_time")

    def set_aside(self, name: str, rows: DataFrame) -> None:
        """Keep rows that belong to a dataset but cannot be stored in it."""
        rows.write.parquet(f"{self.root}/{name}/aside/{uuid.uuid4().hex}")

    def aside(self, name: str) -> DataFrame | None:
        """All rows set aside for a dataset; None if there never were any."""
        folders = self._complete_folders(f"{self.root}/{name}/aside")
        if not folders:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*folders)

    # -- parts -------------------------------------------------------------------

    def _folder(self, dataset: Dataset, kind: str) -> str:
        return f"{self.root}/{dataset.name}/{kind}"

    def _bucket(self, dataset: Dataset, buckets: int) -> Column:
        return F.pmod(F.xxhash64(dataset.key), F.lit(buckets)).cast("bigint")

    def _periods_of(self, dataset: Dataset, *bounds: datetime | None) -> list[str | None]:
        """Names of the periods that moments lie in."""
        named = [
            F.date_format(F.lit(b).cast("timestamp_ntz"), dataset.period).cast("string").alias(f"p{i}")
            for i, b in enumerate(bounds)
        ]
        return list(self.spark.range(1).select(*named).first())

    def _complete_folders(self, folder: str) -> list[str]:
        """Folders inside `folder` whose writer has finished."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = [status.getPath() for status in system.listStatus(path) if status.isDirectory()]
        done = lambda p: system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(p.toString() for p in found if done(p))

    def _newest_commit(self, dataset: Dataset) -> tuple[int, str] | None:
        """Number and folder of the newest complete commit, by names alone; of two with the
        same number the one of the smaller name, for all readers alike."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(dataset, "commits"))
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return None
        names = [s.getPath().getName() for s in system.listStatus(path)]
        numbered = [(int(m[1]), n) for n in names if (m := re.fullmatch(r"(\d+)-[0-9a-f]+", n))]
        for number, name in sorted(numbered, key=lambda x: (-x[0], x[1])):
            folder = f"{self._folder(dataset, 'commits')}/{name}"
            if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")):
                return number, folder
        return None

    def _buckets_of(self, dataset: Dataset, keys: DataFrame, buckets: int) -> set[int]:
        return {row[0] for row in keys.select(self._bucket(dataset, buckets)).distinct().collect()}

    def _placed(self, dataset: Dataset, rows: DataFrame, buckets: int) -> DataFrame:
        period = F.date_format(dataset.time, dataset.period) if dataset.time else F.lit(None)
        return rows.withColumns(
            {
                "period": F.coalesce(period, F.lit(ALL_TIMES)),
                "bucket": self._bucket(dataset, buckets),
            }
        )

    def _with_writers(
        self, dataset: Dataset, rows: DataFrame, stored: StructType, now: Column
    ) -> tuple[Dataset, DataFrame]:
        """Rows without writers that meet cells which have some were written at the time of the refresh."""
        if dataset.stamp or WRITTEN not in stored.names:
            return dataset, rows
        writer = stored[WRITTEN].dataType.valueType
        for f in writer.fields:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, (now if f.name == writer[0].name else F.lit(None)).cast(f.dataType))
        stamp = tuple(writer.names)
        rest = (c for c in dataset.order if c not in stamp)
        return replace(dataset, order=(*stamp, *rest), stamp=stamp), rows

    def _upserted(
        self, dataset: Dataset, frames: list[DataFrame], order: tuple[str, ...] = ()
    ) -> DataFrame:
        # The identity decides the place, so grouping by both groups by the identity.
        keys = [*dataset.identity, *PLACE]
        if dataset.stamp:
            return upsert_stamped(frames, keys, dataset.present)
        return upsert_agg(frames, keys, list(order), dataset.present)

    def _written(self, dataset: Dataset, rows: DataFrame) -> Generation:
        """Write rows as a new generation; rebalancing cuts large partitions in several."""
        gen = uuid.uuid4().hex
        folder = f"{self._folder(dataset, 'data')}/gen={gen}"
        inside = [dataset.key, *([dataset.time] if dataset.time else [])]
        (
            rows.hint("rebalance", *(F.col(c) for c in PLACE))
            .sortWithinPartitions(*PLACE, *inside)
            .write.partitionBy(*PLACE)
            .parquet(folder)
        )
        fields = StructType([f for f in rows.schema if f.name not in PLACE])
        stored = self._generations(dataset, fields, [folder]).drop("gen")
        # The names of the folders are enough: no file is opened.
        places = re.findall(r"/period=([^/]+)/bucket=(\d+)/", "\n".join(stored.inputFiles()))
        return Generation(stored, {(period, int(bucket)): gen for period, bucket in places})

    def _manifest_rows(self, manifest: Manifest) -> DataFrame:
        rows = [(*place, gen) for place, gen in manifest.items()]
        return self.spark.createDataFrame(rows, MANIFEST_SCHEMA)

    def _generations(self, dataset: Dataset, fields: StructType, folders: list[str]) -> DataFrame:
        schema = StructType([*fields.fields, StructField("gen", StringType()), *PLACE_FIELDS])
        base = self._folder(dataset, "data")
        return self.spark.read.schema(schema).option("basePath", base).parquet(*folders)

    def _rows(self, dataset: Dataset, fields: StructType, manifest: Manifest) -> DataFrame:
        """Rows of the listed partitions."""
        if not manifest:
            return self.spark.createDataFrame([], StructType([*fields.fields, *PLACE_FIELDS]))
        base = self._folder(dataset, "data")
        folders = [f"{base}/gen={gen}/period={p}/bucket={b}" for (p, b), gen in manifest.items()]
        return self._generations(dataset, fields, folders).drop("gen")

    def _of_keys(self, rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
        """Few keys become a pushed-down list; many stay a join."""
        few = keys.select(key).limit(FEW_KEYS + 1).collect()
        if len(few) <= FEW_KEYS:
            return rows.where(F.col(key).isin([row[0] for row in few]))
        return rows.join(keys, key, "left_semi")

    def _written_marks(
        self,
        dataset: Dataset,
        old: list[tuple[str, int]],
        keys: DataFrame,
        arrived: DataFrame,
        now: Column,
    ) -> list[tuple[str, int]]:
        """Marks after a refresh; a key without new rows counts as fetched, too.

        Only marks that changed are written. The newest lists become one where they are
        many, with every older list that has no more rows than those behind it.
        """
        key = dataset.key
        latest = F.max(dataset.time) if dataset.time else F.max(F.lit(None))
        high = arrived.groupBy(key).agg(latest.cast("timestamp_ntz").alias("high_water"))
        fetched = keys.select(key).distinct().withColumn("fetched_at", now.cast("timestamp_ntz"))
        marks = [*old, self._new_marks(dataset, fetched.join(high, key, "left"))]
        if len(marks) <= MOST_MARKS:
            return marks
        first = len(marks) - FOLDED_MARKS
        rows = sum(n for _, n in marks[first:])
        while first and marks[first - 1][1] <= rows:
            first -= 1
            rows += marks[first][1]
        folded = self._folded(dataset, [path for path, _ in marks[first:]])
        return [*marks[:first], self._new_marks(dataset, folded)]

    def _new_marks(self, dataset: Dataset, marks: DataFrame) -> tuple[str, int]:
        path = f"{self._folder(dataset, 'marks')}/{uuid.uuid4().hex}"
        marks.write.parquet(path)
        return path, self.spark.read.schema(marks.schema).parquet(path).count()

    def _folded(self, dataset: Dataset, paths: list[str]) -> DataFrame:
        """(key, fetched_at, high_water): one row per key of the listed changes."""
        schema = f"`{dataset.key}` string, fetched_at timestamp_ntz, high_water timestamp_ntz"
        if not paths:
            return self.spark.createDataFrame([], schema)
        changes = self.spark.read.schema(schema).parquet(*paths)
        if len(paths) == 1:
            return changes
        return changes.groupBy(dataset.key).agg(
            F.max("fetched_at").alias("fetched_at"), F.max("high_water").alias("high_water")
        )

    def _write_commit(self, dataset: Dataset, version: Version, marks: list[tuple[str, int]]) -> None:
        """The version with these marks. Fails if another writer has committed the same version."""
        rows = [(*place, gen, None, None, None) for place, gen in version.manifest.items()]
        rows.append((None, None, None, json.dumps(marks), version.fields.json(), version.buckets))
        commit = self.spark.createDataFrame(rows, COMMIT_SCHEMA).coalesce(1)
        before = self._newest_commit(dataset)
        folder = f"{self._folder(dataset, 'commits')}/{version.number}-{uuid.uuid4().hex}"
        if before is None or before[0] < version.number:
            commit.write.parquet(folder)
            before = self._newest_commit(dataset)
        if before[1] != folder:
            raise ValueError(f"{dataset.name}: version {version.number} already exists")

    def _latest(self, dataset: Dataset) -> Version:
        newest = self._newest_commit(dataset)
        if newest is None:
            return Version(0, {}, [], StructType([StructField(dataset.key, StringType())]), self.buckets)
        number, folder = newest
        rows = self.spark.read.schema(COMMIT_SCHEMA).parquet(folder).collect()
        extra = next(r for r in rows if r.gen is None)
        return Version(
            number,
            {(r.period, r.bucket): r.gen for r in rows if r.gen is not None},
            [(path, rows) for path, rows in json.loads(extra.marks)],
            StructType.fromJson(json.loads(extra.fields)),
            extra.buckets,
        )
