"""The operators as queries over the test tables, each with the SQL it must agree with.

Stand-ins: a site is `events.user_id` or `lineitem.l_suppkey`, a station a supplier or
customer, a state a nation. Tables are rendered as station text inside the plan and
read back by the operators, so that every query works on whole tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydroframe.functions import cells, times
from hydroframe.operators import observations, refresh, stations, upsert
from hydroframe.operators.parameters import MARKER, parameter_table
from hydroframe.plans import requests
from hydroframe.plans.store import Dataset, Store
from hydroframe.session import shared_folder
from hydroframe.sources import html
from hydroframe.sources.rdb import RdbText

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, next to the SQL it must equal."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(moment: str) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


def tabbed(*columns: str) -> Column:
    """The columns as one line; a null becomes an empty cell."""
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def numbered_lines(df: DataFrame, file: Column, line: Column, value: Column) -> DataFrame:
    return df.select(
        file.cast("string").alias("file"),
        F.lit(0).cast("bigint").alias("block"),
        line.cast("bigint").alias("line"),
        value.alias("value"),
    )


def head_of(files: DataFrame, *lines: Column) -> DataFrame:
    """The same first lines for every file, numbered from below zero."""
    numbered = F.posexplode(F.array(*lines)).alias("at", "value")
    rows = files.select("file", numbered)
    return rows.select(
        "file",
        F.lit(0).cast("bigint").alias("block"),
        (F.col("at") - len(lines)).cast("bigint").alias("line"),
        "value",
    )


# -- station files ---------------------------------------------------------------

EVENT_COLUMNS = {
    "event_id": "10n", "ts": "20d", "user_id": "15s", "event_type": "20s", "value": "14n",
}


def event_text(spark: SparkSession, sf_dir: str) -> RdbText:
    """Events as one station file per user."""
    events = load(spark, sf_dir, "events")
    body = numbered_lines(events, F.col("user_id"), F.col("event_id"), tabbed(*EVENT_COLUMNS))
    head = head_of(
        events.select(F.col("user_id").cast("string").alias("file")).distinct(),
        F.lit("# event log"),
        F.lit("#"),
        F.lit("\t".join(EVENT_COLUMNS)),
        F.lit("\t".join(EVENT_COLUMNS.values())),
    )
    return RdbText(lines=body, head_lines=head)


@query("""
select cast(event_id as double) event_id, ts, cast(user_id as varchar) user_id, event_type, value
from events
""")
def rdb_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_text(spark, sf_dir).table(EVENT_COLUMNS)


@query("""
select cast(c_custkey as varchar) site_no, c_name station_nm, c_acctbal balance,
       nullif(c_mktsegment, 'NA') segment
from customer
""")
def rdb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one whole file each; machinery files order their columns otherwise."""
    usual = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    other = ("c_mktsegment", "c_acctbal", "c_name", "c_custkey")
    title = {
        "c_custkey": ("site_no", "15s"), "c_name": ("station_nm", "50s"),
        "c_acctbal": ("balance", "14n"), "c_mktsegment": ("segment", "20s"),
    }

    def document(columns: tuple[str, ...]) -> Column:
        names = "\t".join(title[c][0] for c in columns)
        codes = "\t".join(title[c][1] for c in columns)
        return F.concat(F.lit(f"# customer #1\r\n#\r\n{names}\r\n{codes}\r\n"), tabbed(*columns), F.lit("\r\n"))

    documents = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("file"),
        F.when(F.col("c_mktsegment") == "MACHINERY", document(other))
        .otherwise(document(usual))
        .alias("value"),
    )
    return RdbText(documents=documents).table(dict(title.values()))


# The service's marker with room for longer codes.
WIDE_MARKER = f"{MARKER.split()[0]}{' ' * 12}{MARKER.split()[1]}{' ' * 32}{MARKER.split()[2]}"


def parameter_line(number: str, code: str, text: str, marker: str = MARKER) -> Column:
    """A line of a parameter table, its cells below the words of the marker."""
    words = marker.split()
    code_at, text_at = marker.index(words[1]), marker.index(words[2])
    return F.concat(
        F.lit("#   "),
        F.rpad(F.col(number).cast("string"), code_at, " "),
        F.rpad(F.col(code), text_at - code_at, " "),
        F.col(text),
    )


@query("select p_brand file, cast(p_partkey as varchar) k, p_type b, p_name n from part")
def param_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as one comment header per brand, with noise before and behind the table."""
    part = load(spark, sf_dir, "part")
    files = part.select(F.col("p_brand").alias("file")).distinct()
    rendered = parameter_line("p_partkey", "p_type", "p_name", WIDE_MARKER)
    table = numbered_lines(part, F.col("p_brand"), F.col("p_partkey"), rendered)
    # The closing lines come last whatever the number of parts.
    last = F.lit(2**62)
    ends = files.select("file", F.posexplode(F.array(F.lit("#"), F.lit("#   P  Provisional"))))
    after = numbered_lines(ends, F.col("file"), last + F.col("pos"), F.col("col"))
    before = head_of(files, F.lit("# ---- WARNING ----"), F.lit("#"), F.lit(f"#   {WIDE_MARKER}"))
    lines = before.unionByName(table).unionByName(after)
    return parameter_table(RdbText(lines=lines, head_lines=lines), WIDE_MARKER).select(
        "file",
        F.col("TS_ID").alias("k"),
        F.col("Parameter").alias("b"),
        F.col("Description").alias("n"),
    )


@query("""
select cast(p_partkey as varchar) file, p_brand description, cast(p_size as varchar) parameter_cd
from part
union all
select cast(p_partkey as varchar), p_name, cast(p_size + 1 as varchar) from part
""")
def param_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as one whole file each, with a parameter table of two series."""
    part = load(spark, sf_dir, "part").withColumns(
        {
            "first": F.col("p_size").cast("string"),
            "second": (F.col("p_size") + 1).cast("string"),
        }
    )
    documents = part.select(
        F.col("p_partkey").cast("string").alias("file"),
        F.concat_ws(
            "\n",
            F.lit("# ---- WARNING ----"),
            F.lit("#"),
            F.lit(f"#   {MARKER}"),
            parameter_line("p_partkey", "first", "p_brand"),
            parameter_line("p_partkey", "second", "p_name"),
            F.lit("#"),
            F.lit("#   P  Provisional"),
            F.lit("site_no\n15s"),
            F.col("p_partkey").cast("string"),
        ).alias("value"),
    )
    return parameter_table(RdbText(documents=documents)).select(
        "file",
        F.col("Description").alias("description"),
        F.col("Parameter").alias("parameter_cd"),
    )


def raw_event_value() -> Column:
    """Event values as written; errors hold a word, signups a number with a letter."""
    kind = F.col("event_type")
    return (
        F.when(kind == "error", "Ice")
        .when(kind == "signup", "1d")
        .otherwise(F.col("value").cast("string"))
    )


@query("""
select event_type, count(*) n,
       count(case when event_type in ('error', 'signup') then null else value end) ok,
       count(*) filter (event_type in ('error', 'signup')) bad
from events group by 1
""")
def dtype_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "events").select("event_type", raw_event_value().alias("raw"))
    read = raw.withColumn("value", cells.number_cell(F.col("raw")))
    return read.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("value").alias("ok"),
        F.count(F.when(cells.is_bad(F.col("raw"), F.col("value")), 1)).alias("bad"),
    )


@query("""
select cast(user_id as varchar) site_no, ts datetime,
       case event_type when 'error' then 'Ice' else '1d' end raw
from events where event_type in ('error', 'signup')
""")
def bad_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as station files of one series; the cells that are no number."""
    events = load(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", raw_event_value().alias("raw")
    )
    body = numbered_lines(events, F.col("user_id"), F.col("event_id"), tabbed("user_id", "ts", "raw"))
    head = head_of(
        events.select(F.col("user_id").cast("string").alias("file")).distinct(),
        F.concat(F.lit("site_no\tdatetime\t"), F.col("file"), F.lit("_00065")),
        F.lit("15s\t20d\t14n"),
    )
    long = observations.long_observations(RdbText(lines=body, head_lines=head))
    return observations.bad_tokens(long).select("site_no", "datetime", "raw")


@query("""
select cast(user_id as varchar) site_no,
       concat_ws(chr(9), cast(user_id as varchar), event_type, props, 'surplus') as value
from events where event_type = 'error'
""")
def rejected_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose error lines have one cell more than their header."""
    events = load(spark, sf_dir, "events")
    surplus = F.when(F.col("event_type") == "error", F.lit("\tsurplus")).otherwise("")
    line = F.concat(tabbed("user_id", "event_type", "props"), surplus)
    body = numbered_lines(events, F.col("user_id"), F.col("event_id"), line)
    head = head_of(
        events.select(F.col("user_id").cast("string").alias("file")).distinct(),
        F.lit("site_no\tkind\tnote"),
        F.lit("15s\t10s\t50s"),
    )
    rejected = RdbText(lines=body, head_lines=head).rejected()
    return rejected.select(F.col("file").alias("site_no"), "value")


@query("""
select cast(l_suppkey as varchar) site_no, l_shipdate datetime, cast(l_suppkey as varchar) ts_id,
       '00060' parameter_cd, l_quantity as value, l_returnflag qualifier
from lineitem
union all
select cast(l_suppkey as varchar), l_shipdate, '1', '00010', l_tax, l_linestatus from lineitem
""")
def long_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as one file per supplier, whose column names hold the supplier."""
    items = load(spark, sf_dir, "lineitem")
    values = tabbed(
        "l_suppkey", "l_shipdate", "l_quantity", "l_returnflag", "l_tax", "l_linestatus"
    )
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    body = numbered_lines(items, F.col("l_suppkey"), number, values)
    flow = F.concat(F.col("file"), F.lit("_00060"))
    head = head_of(
        items.select(F.col("l_suppkey").cast("string").alias("file")).distinct(),
        F.lit("# shipments"),
        F.concat_ws(
            "\t", F.lit("site_no\tdatetime"), flow, F.concat(flow, F.lit("_cd")),
            F.lit("1_00010\t1_00010_cd"),
        ),
        F.lit("15s\t20d\t14n\t10s\t14n\t10s"),
    )
    return observations.long_observations(RdbText(lines=body, head_lines=head)).select(
        "site_no", "datetime", "ts_id", "parameter_cd", "value", "qualifier"
    )


@query("""
select cast(l_suppkey as varchar) site_no, l_shipdate datetime, '1' ts_id, '00060' parameter_cd,
       '00003' statistic_cd, l_quantity as value, l_returnflag qualifier,
       l_linestatus line_status, cast(l_linenumber as varchar) line_no
from lineitem
""")
def observation_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a statistic in the column's name and two columns that are no values."""
    items = load(spark, sf_dir, "lineitem")
    values = tabbed("l_suppkey", "l_shipdate", "l_linestatus", "l_quantity", "l_returnflag", "l_linenumber")
    number = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    body = numbered_lines(items, F.col("l_suppkey"), number, values)
    head = head_of(
        items.select(F.col("l_suppkey").cast("string").alias("file")).distinct(),
        F.lit("site_no\tdatetime\tline_status\t1_00060_00003\t1_00060_00003_cd\tline_no"),
        F.lit("15s\t20d\t10s\t14n\t10s\t5s"),
    )
    long = observations.long_observations(RdbText(lines=body, head_lines=head))
    return long.select(
        "site_no", "datetime", "ts_id", "parameter_cd", "statistic_cd", "value", "qualifier",
        F.col("attributes")["line_status"].alias("line_status"), F.col("attributes")["line_no"].alias("line_no"),
    )


@query("""
select cast(cid as integer) position, name,
       case type when 'TIMESTAMP' then 'timestamp_ntz' when 'VARCHAR' then 'string' else lower(type) end as type
from pragma_table_info('events')
""")
def schema_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the events table."""
    return stations.schema_table(load(spark, sf_dir, "events"))


# -- observations ----------------------------------------------------------------


@query("select * from events where ts >= timestamp '1900-01-01'")
def full_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.full_history(load(spark, sf_dir, "events"), "ts")


@query("""
select event_id, user_id, ts, value from events
where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-06'
""")
def station_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return observations.in_window(events, "2024-01-05", "2024-01-06", "ts")


@query("select ts, value from events where event_type = 'click'")
def series_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return observations.select_series(events, "event_type", "click", "ts", "value")


@query("""
select cast(ts as date) d, nullif(count(*) filter (event_type = 'click'), 0) click,
       nullif(count(*) filter (event_type = 'view'), 0) "view"
from events group by 1
""")
def wide_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = load(spark, sf_dir, "events").select(F.to_date("ts").alias("d"), "event_type")
    return observations.wide_observations(
        days, ["d"], "event_type", ["click", "view"], F.count(F.lit(1))
    )


@query("""
select p parameter_cd, d description, count(*) n, round(sum(v), 2) s
from (unpivot (select l_quantity, l_tax from lineitem) on l_quantity, l_tax into name k value v)
join (values ('l_quantity', '00060', 'Quantity'), ('l_tax', '00010', 'Tax rate')) t(k, p, d)
using (k) group by 1, 2
""")
def param_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = observations.unpivoted(load(spark, sf_dir, "lineitem"), [], ["l_quantity", "l_tax"])
    names = spark.createDataFrame(
        [("l_quantity", "00060", "Quantity"), ("l_tax", "00010", "Tax rate")],
        "series string, parameter_cd string, description string",
    )
    return (
        observations.with_parameters(long, names, ["series"])
        .groupBy("parameter_cd", "description")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("s"))
    )


@query("select user_id, max(ts) ts, arg_max(value, ts) as value from events group by 1")
def last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.last_values(load(spark, sf_dir, "events"), ["user_id"], "ts", "value")


# -- stations --------------------------------------------------------------------


@query("""
select * from supplier
where s_nationkey in (select n_nationkey from nation where n_regionkey = 2)
""")
def stations_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = load(spark, sf_dir, "nation").where("n_regionkey = 2")
    states = wanted.select(F.col("n_nationkey").alias("s_nationkey"))
    return stations.stations_of(load(spark, sf_dir, "supplier"), states, "s_nationkey")


@query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def equal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer")
    found = stations.stations_with(customers, "BUILDING", "c_mktsegment")
    return found.select("c_custkey", "c_name")


@query("""
select p_brand, count(*) n, bool_and(regexp_matches(p_name, 'ring')) ok from part group by 1
""")
def name_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.name_check(load(spark, sf_dir, "part"), "ring", "p_name", ["p_brand"])


@query("""
select * from (
  select c_custkey, c_acctbal dec_lat_va,
         case when c_mktsegment = 'BUILDING' then null else c_nationkey + 0.5::double end dec_long_va,
         nullif(c_mktsegment, 'MACHINERY') segment
  from customer)
where dec_lat_va is not null and dec_long_va is not null and segment is not null
""")
def point_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stations, some without a name, some with a word as longitude."""
    segment = F.col("c_mktsegment")
    sites = load(spark, sf_dir, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("dec_lat_va"),
        F.when(segment == "BUILDING", "unknown")
        .otherwise(F.concat(F.col("c_nationkey").cast("string"), F.lit(".5")))
        .alias("dec_long_va"),
        F.nullif(segment, F.lit("MACHINERY")).alias("segment"),
    )
    return stations.point_layer(sites)


@query('select user_id, min(ts) "begin", max(ts) "end", count(*) n from events group by 1')
def series_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.series_span(load(spark, sf_dir, "events"), ["user_id"], "ts", "ts")


@query("""
select count(*) n, count(event_id) event_id, count(ts) ts, count(user_id) user_id,
       count(event_type) event_type, count(value) as value, count(props) props
from events
""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.profile(load(spark, sf_dir, "events"))


@query("select * from events order by ts, event_id limit 5")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.head(load(spark, sf_dir, "events"), 5, "ts", "event_id")


# -- refresh ---------------------------------------------------------------------

NOW = "2024-01-31"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))


@query("""
select c_custkey user_id, coalesce(strftime(m, '%Y-%m-%d'), '1900-01-01') since
from customer left join (select user_id, max(ts) m from events group by 1) on c_custkey = user_id
""")
def high_water_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = refresh.high_water_mark(load(spark, sf_dir, "events"), ["user_id"], "ts")
    return refresh.refetch_since(users(spark, sf_dir), marks, ["user_id"])


@query(f"""
select c_custkey user_id, f fetched_at,
       coalesce(timestamp '{NOW}' - f > interval 1 day, true) stale
from customer left join (select user_id, max(ts) f from events group by 1) on c_custkey = user_id
""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = refresh.newest_fetch(load(spark, sf_dir, "events"), ["user_id"], "ts")
    return refresh.freshness(users(spark, sf_dir), marks, ["user_id"], "1D", local(NOW))


@query("""
select o_custkey, min(o_orderdate) fetched_at,
       bool_or(timestamp '1999-01-01' - o_orderdate > interval 365 day) stale
from orders group by 1
""")
def parts_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as the parts of one stored frame."""
    parts = load(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    return refresh.any_part_stale(
        parts, ["o_custkey"], "365D", local("1999-01-01"), "o_orderdate"
    )


STALE_SQL = f"""
select c_custkey user_id from customer where c_custkey not in
  (select user_id from events group by 1 having timestamp '{NOW}' - max(ts) <= interval 1 day)
"""


@query(STALE_SQL)
def stale_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    requested = users(spark, sf_dir)
    marks = refresh.newest_fetch(load(spark, sf_dir, "events"), ["user_id"], "ts")
    fresh = marks.where(~refresh.is_stale(F.col("fetched_at"), "1D", local(NOW)))
    _, to_compute = refresh.stale_split(requested, fresh, ["user_id"])
    return to_compute


def stored_and_refetched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events stored up to a moment, and those fetched again from each user's last day."""
    events = load(spark, sf_dir, "events").select("user_id", "ts", "value", "event_type")
    stored = events.where(F.col("ts") < local("2024-01-20 12:00:00"))
    marks = refresh.high_water_mark(stored, ["user_id"], "ts")
    since = marks.select("user_id", F.to_date("high_water").alias("since"))
    refetched = (
        events.join(since, "user_id", "left")
        .where(F.col("since").isNull() | (F.col("ts") >= F.col("since")))
        .select(
            "user_id",
            "ts",
            F.when(F.col("event_type") != "error", F.col("value") * 2).alias("value"),
            F.lit("A").alias("q"),
        )
    )
    return refetched, stored.select("user_id", "ts", "value", F.lit("P").alias("q"))


UPSERT_SQL = """
with cached as (select user_id, ts, value, 'P' q from events where ts < timestamp '2024-01-20 12:00:00'),
 cur as (select user_id, cast(max(ts) as date) since from cached group by 1),
 latest as (select e.user_id, e.ts, case when event_type <> 'error' then value * 2 end as value, 'A' q
            from events e left join cur using (user_id) where since is null or e.ts >= since)
select user_id, ts, coalesce(n.value, o.value) as value, coalesce(n.q, o.q) q
from latest n full join cached o using (user_id, ts)
"""


@query(UPSERT_SQL)
def upsert_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert_join(*stored_and_refetched(spark, sf_dir), ["user_id", "ts"])


@query(UPSERT_SQL)
def upsert_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.upsert_agg(list(stored_and_refetched(spark, sf_dir)), ["user_id", "ts"])


@query(f"""
select cast(user_id as varchar) user_id, ts, value, q from ({UPSERT_SQL})
where user_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')
  and ts between timestamp '2024-01-05' and timestamp '2024-01-25'
""")
def store_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events kept in a store, refreshed there from each user's last day, and some users' window read back."""
    events = load(spark, sf_dir, "events").withColumn("user_id", F.col("user_id").cast("string"))
    dataset = Dataset("events", key="user_id", ttl="1D", identity=("user_id", "ts"), time="ts")
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", buckets=4)

    @store.cached(dataset)
    def kept(requested: DataFrame) -> DataFrame:
        """What the service knew at first."""
        known = events.where(F.col("ts") < local("2024-01-20 12:00:00")).join(requested, "user_id")
        return known.select("user_id", "ts", "value", F.lit("P").alias("q"))

    @store.cached(dataset)
    def refreshed(requested: DataFrame) -> DataFrame:
        """What it knows later: other values from the day asked for, and none for errors."""
        known = events.join(requested, "user_id").where(F.col("ts") >= F.col("since").cast("timestamp_ntz"))
        value = F.when(F.col("event_type") != "error", F.col("value") * 2)
        return known.select("user_id", "ts", value.alias("value"), F.lit("A").alias("q"))

    keys = events.select("user_id")
    kept(keys, local("2024-01-20 12:00:00"))
    refreshed(keys, local(NOW))
    some = load(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    wanted = some.select(F.col("c_custkey").cast("string").alias("user_id"))
    return store.read(dataset, wanted, "2024-01-05", "2024-01-25")


@query("""
select cast(case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as int) part_idx,
       count(*) n, count(case when o_orderstatus <> 'P' then o_totalprice end) price,
       count(case when o_orderstatus = 'P' then o_orderpriority end) priority
from orders group by 1
""")
def stacked_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of each status as one part; the parts do not have the same columns."""
    orders = load(spark, sf_dir, "orders")
    parts = [
        orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"),
        orders.where("o_orderstatus = 'O'").select("o_totalprice", "o_orderkey"),
        orders.where("o_orderstatus not in ('F', 'O')").select("o_orderkey", "o_orderpriority"),
    ]
    return upsert.stacked_parts(parts).groupBy("part_idx").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("o_totalprice").alias("price"),
        F.count("o_orderpriority").alias("priority"),
    )


# -- requests and dates ----------------------------------------------------------


@query("""
select cast(k as varchar) site_no, cast(y as int) "year",
       printf('b/iv/?format=rdb,1.0&sites=%d&startDT=%d-01-01&endDT=%d-12-31&siteStatus=all', k, y, y) url
from (select o_custkey k, unnest(range(year(min(o_orderdate)), year(max(o_orderdate)) + 1)) y
      from orders group by 1)
""")
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the years of its orders; the two dates are given in reverse."""
    sites = (
        load(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").cast("string").alias("site_no"))
        .agg(F.max("o_orderdate").alias("last"), F.min("o_orderdate").alias("first"))
    )
    start, end = F.col("last").cast("string"), F.col("first").cast("string")
    plan = requests.yearly_requests("b", sites, start, end, local(NOW))
    return plan.select("site_no", "year", "url")


@query("""
select c_custkey,
       printf('b/site/?format=rdb,1.0&stateCd=%s&siteStatus=all', n_name) stations,
       printf('b/iv/?format=rdb,1.0&sites=%d&startDT=1900-01-01&siteStatus=all', c_custkey) history,
       printf('b/iv/?format=rdb,1.0&sites=%d&siteStatus=all', c_custkey) parameters,
       printf('b/site/?format=rdb,1.0&sites=%d&seriesCatalogOutput=true&siteStatus=all', c_custkey) catalog
from customer join nation on c_nationkey = n_nationkey
""")
def service_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = load(spark, sf_dir, "nation")
    sites = load(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    site = F.col("c_custkey").cast("string")
    start = F.lit(observations.HISTORY_START)
    return sites.select(
        "c_custkey",
        requests.stations_url("b", F.col("n_name")).alias("stations"),
        requests.values_url("b", site, start).alias("history"),
        requests.parameters_url("b", site).alias("parameters"),
        requests.catalog_url("b", site).alias("catalog"),
    )


@query("""
select o_orderkey,
  case when s <> 'junk' then strftime(least(d, timestamp '1998-01-01'), '%Y-%m-%d') end a,
  case when s <> 'junk' then strftime(greatest(d, timestamp '1998-01-01'), '%Y-%m-%d') end b,
  cast(year(d) as int) y, coalesce(strftime(try_cast(s as timestamp), '%Y-%m-%d'), '') safe
from (select o_orderkey, s, case when s = '' then timestamp '2024-01-31' else try_cast(s as timestamp) end d
      from (select o_orderkey, case o_orderstatus when 'P' then '' when 'F' then 'junk'
                               else strftime(o_orderdate, '%Y-%m-%d') end s from orders))
""")
def time_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(status == "P", "").when(status == "F", "junk")
        .otherwise(times.day_text(F.col("o_orderdate"))).alias("s"),
    )
    text, now = F.col("s"), local(NOW)
    first, last = times.ordered_days(text, F.lit("1998-01-01"), now)
    return orders.select(
        "o_orderkey",
        first.alias("a"),
        last.alias("b"),
        times.year_of(text, now).alias("y"),
        times.safe_day_text(text).alias("safe"),
    )


# -- pages -----------------------------------------------------------------------


@query("""
select page_id, cast(i as int) i, x[i + 1] cell
from (select page_id, x, unnest(range(len(x))) i
      from (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) x from pages))
""")
def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_cells(load(spark, sf_dir, "pages"), "page_id", "<li>(.*?)</li>")


@query("""
select page_id, cast(i as int) "row", regexp_replace(x[i + 1], '<[^>]*>', '', 'g') name, regexp_extract(x[i + 1], 'href="([^"]*)"', 1) address
from (select page_id, x, unnest(range(len(x))) i
      from (select page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) x from pages))
""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page with its list of links turned into a table, read back by column name."""
    row = "<tr><td>$1</td>\n<td class=\"n\"><b>$2</b></td></tr>"
    head = "<TABLE><tr><th>address</th><th>name</th></tr>"
    page = F.regexp_replace("html", r'<li><a href="([^"]*)">([^<]*)</a></li>', row)
    page = F.replace(F.replace(page, F.lit("<ul>"), F.lit(head)), F.lit("</ul>"), F.lit("</TABLE>"))
    pages = load(spark, sf_dir, "pages").select("page_id", page.alias("html"))
    return html.html_table(pages, "page_id", {"name": "string", "address": "string"})


# -- flagship --------------------------------------------------------------------


@query("""
select cast(user_id as varchar) user_id, min(ts) "begin", max(ts) "end", count(*) n
from events where ts >= timestamp '2024-01-05' and ts <= timestamp '2024-01-20' group by 1
""")
def window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station files read, cut to a window and summarised per site."""
    rows = event_text(spark, sf_dir).table({"user_id": "15s", "ts": "20d"})
    rows = observations.in_window(rows, "2024-01-05", "2024-01-20", "ts")
    return stations.series_span(rows, ["user_id"], "ts", "ts")
