"""Station data by state and site: the service behind a refreshable store.

Every method takes one key, a list or a DataFrame of keys and answers all of them in
one DataFrame. Stale or unknown keys are fetched first, fresh ones are only read.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.operators.observations import (
    HISTORY_START,
    SERIES_KEY,
    in_window,
    long_observations,
    moments,
    wide_observations,
)
from hydroframe.operators.parameters import parameter_table
from hydroframe.plans import requests
from hydroframe.plans.store import Bound, Dataset, Store
from hydroframe.sources.html import html_table
from hydroframe.sources.rdb import RdbText
from hydroframe.sources.service import fetch_pages, land_requests

# Lifetimes of the datasets.
STATIONS = Dataset("stations", key="state", ttl="1D")
OBSERVATIONS = Dataset(
    "observations",
    key="site_no",
    ttl="1H",
    identity=SERIES_KEY,
    order=("file", "block", "line"),
    present={"value": "raw"},
    time="datetime",
)
PARAMETERS = Dataset("parameters", key="site_no", ttl="1D")
CATALOG = Dataset("catalog", key="requested_site", ttl="1D")
SITE_TYPES = Dataset("site_types", key="url", ttl="1D")

Keys = str | list[str] | DataFrame


class StationReader:
    """`base_url` is the service; `store` keeps what was fetched.

    Lines with more cells than columns, and observations whose time cannot be read, are
    not stored but set aside as they came (`rejected`, `unplaced`).
    """

    def __init__(self, base_url: str, store: Store, tasks: int | None = None):
        self.base_url = base_url
        self.store = store
        self.spark = store.spark
        self.tasks = tasks

    def read_stations_for_state(self, states: Keys, now: datetime | None = None) -> DataFrame:
        """All stations of the states, whatever their status."""

        def fetch(todo: DataFrame) -> DataFrame:
            plan = todo.withColumn("url", requests.stations_url(self.base_url, F.col("state")))
            text = self._land("stations", plan, "state")
            return text.table(text.merged_columns(), file_as="state")

        return self._materialized(STATIONS, states, fetch, now)

    def read_station_data(
        self,
        sites: Keys,
        start: Bound = None,
        end: Bound = None,
        now: datetime | None = None,
    ) -> DataFrame:
        """Observations in the closed window; the store keeps the whole history."""

        def fetch(todo: DataFrame) -> DataFrame:
            url = requests.values_url(self.base_url, F.col("site_no"), F.col("since"))
            text = self._fetched("observations", todo.withColumn("url", url), "site_no")
            return self.store.routed("observations", text)

        return self._materialized(OBSERVATIONS, sites, fetch, now, start, end)

    def read_entire_station_data_for(self, sites: Keys) -> DataFrame:
        """Observations since the start of history, fetched without the store's help."""
        keys = self._keys(sites, "site_no")
        url = requests.values_url(self.base_url, F.col("site_no"), F.lit(HISTORY_START))
        return long_observations(self._land("full", keys.withColumn("url", url), "site_no"))

    def read_station_data_by_year(
        self, sites: Keys, start: Bound, end: Bound, now: datetime | None = None
    ) -> DataFrame:
        """Observations in the window, fetched with one request per site and year."""
        keys, run_ts = self._keys(sites, "site_no"), self._now(now)
        first, last = sorted(moments(self.spark, start or _text(now), end or _text(now)))
        bounds = (F.lit(first.isoformat(sep=" ")), F.lit(last.isoformat(sep=" ")))
        plan = requests.yearly_requests(self.base_url, keys, *bounds, run_ts)
        rows = self.store.routed("yearly", self._fetched("yearly", plan, "url"))
        return in_window(rows, first, last)

    def rejected(self, name: str) -> DataFrame | None:
        """(file, block, line, value) of lines with more cells than columns, of all fetches of
        `name` (stations, observations, full, yearly, parameters, catalog)."""
        return self.store.aside(f"rejected-{name}")

    def unplaced(self, name: str) -> DataFrame | None:
        """Observations without a readable time, with what stood there in `raw_time`."""
        return self.store.aside(f"unplaced-{name}")

    def read_station_parameters(self, sites: Keys, now: datetime | None = None) -> DataFrame:
        """The sites' series with their descriptions."""

        def fetch(todo: DataFrame) -> DataFrame:
            plan = todo.withColumn("url", requests.parameters_url(self.base_url, F.col("site_no")))
            table = parameter_table(self._land("parameters", plan, "site_no"))
            return table.withColumnRenamed("file", "site_no")

        return self._materialized(PARAMETERS, sites, fetch, now)

    def read_station_detailed_info(self, sites: Keys, now: datetime | None = None) -> DataFrame:
        """The sites' series catalogs."""

        def fetch(todo: DataFrame) -> DataFrame:
            plan = todo.withColumn("url", requests.catalog_url(self.base_url, F.col(CATALOG.key)))
            text = self._land("catalog", plan, CATALOG.key)
            return text.table(text.merged_columns(), file_as=CATALOG.key)

        return self._materialized(CATALOG, sites, fetch, now).drop(CATALOG.key)

    def read_site_type_codes(self, page_url: str, now: datetime | None = None) -> DataFrame:
        """The code table of a page that holds exactly one table."""

        def fetch(todo: DataFrame) -> DataFrame:
            return html_table(fetch_pages(todo, tasks=1), "url")

        return self._materialized(SITE_TYPES, page_url, fetch, now)

    def _materialized(self, dataset, keys, fetch, now, start=None, end=None) -> DataFrame:
        requested = self._keys(keys, dataset.key)
        return self.store.materialize(dataset, requested, fetch, self._now(now), start, end)

    def _fetched(self, name: str, plan: DataFrame, file: str) -> RdbText:
        """The planned responses, landed."""
        folder = f"{self.store.root}/landed/{name}/{uuid.uuid4().hex}"
        return land_requests(plan, folder, "url", file, self.tasks)

    def _land(self, name: str, plan: DataFrame, file: str) -> RdbText:
        text = self._fetched(name, plan, file)
        rejected = text.rejected()
        if not rejected.isEmpty():
            self.store.set_aside(f"rejected-{name}", rejected)
        return text

    def _keys(self, keys: Keys, name: str) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys.select(F.col(name).cast("string"))
        values = [keys] if isinstance(keys, str) else keys
        return self.spark.createDataFrame([(str(v),) for v in values], f"{name} string")

    def _now(self, now: datetime | None) -> Column:
        return F.lit(_text(now)).cast("timestamp_ntz")


def _text(now: datetime | None) -> str:
    moment = now or datetime.now(timezone.utc).replace(tzinfo=None)
    return moment.isoformat(sep=" ")


def as_wide(
    long: DataFrame, series: list[str] | None = None, attributes: list[str] | None = None, most: int = 2000
) -> DataFrame:
    """One column per series, qualifier and attribute, as in the station files.

    `series` and `attributes` name the columns wanted. Without, those found become columns,
    `most` at most: for one site or a few. Of repeated rows the one written last counts.
    """
    name = F.concat_ws("_", "ts_id", "parameter_cd", "statistic_cd")
    if series is None:
        series = _found(long.select(name.alias("name")), most)
    if attributes is None:
        attributes = _found(long.select(F.explode(F.map_keys("attributes")).alias("name")), most)
    cells = long.withColumn("series", name)
    index = ["site_no", "datetime", "tz_cd"]
    place = F.struct(*(c for c in ("file", "block", "line") if c in long.columns), "value", "raw", "qualifier")
    cell = F.max_by(F.struct("value", "qualifier"), place)
    pivoted = wide_observations(cells, index, "series", series, cell)
    last = F.max_by("attributes", place).alias("attributes")
    named = long.groupBy(*index).agg(last)
    same = [pivoted[c].eqNullSafe(named[c]) for c in index]
    joined = pivoted.join(named, same)
    return joined.select(
        *(pivoted[c] for c in index),
        *(named["attributes"][a].alias(a) for a in attributes),
        *(
            column
            for n in series
            for column in (pivoted[n]["value"].alias(n), pivoted[n]["qualifier"].alias(f"{n}_cd"))
        ),
    )


def _found(names: DataFrame, most: int) -> list[str]:
    found = [r[0] for r in names.distinct().orderBy("name").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} columns; name the wanted ones")
    return found
