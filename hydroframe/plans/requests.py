"""Request plans: a table of keys becomes a table of service addresses."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroframe.functions.times import ordered_days

# The service's paths and query parameters.
STATE_STATIONS = "%s/site/?format=rdb,1.0&stateCd=%s&siteStatus=all"
SITE_VALUES = "%s/iv/?format=rdb,1.0&sites=%s&startDT=%s%s&siteStatus=all"
SITE_PARAMETERS = "%s/iv/?format=rdb,1.0&sites=%s&siteStatus=all"
SITE_CATALOG = "%s/site/?format=rdb,1.0&sites=%s&seriesCatalogOutput=true&siteStatus=all"


def stations_url(base: str, state: Column) -> Column:
    return F.format_string(STATE_STATIONS, F.lit(base), state)


def values_url(base: str, site: Column, start: Column, end: Column | None = None) -> Column:
    """Values of a site; without an end (null or empty) the period stays open."""
    if end is None:
        end = F.lit("")
    limit = F.when(F.coalesce(end, F.lit("")) == "", "").otherwise(F.concat(F.lit("&endDT="), end))
    return F.format_string(SITE_VALUES, F.lit(base), site, start, limit)


def parameters_url(base: str, site: Column) -> Column:
    return F.format_string(SITE_PARAMETERS, F.lit(base), site)


def catalog_url(base: str, site: Column) -> Column:
    return F.format_string(SITE_CATALOG, F.lit(base), site)


def each_year(periods: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per calendar year from the first to the last year, both included."""
    return periods.withColumn("year", F.explode(F.sequence(first, last)))


def yearly_requests(
    base: str, sites: DataFrame, start: Column, end: Column, run_ts: Column, site: str = "site_no"
) -> DataFrame:
    """(site, year, url): a site's period cut into one request per calendar year.

    The two dates may come in either order; an empty one means the time of the run.
    """
    first, last = ordered_days(start, end, run_ts)
    years = each_year(sites, F.year(first.cast("date")), F.year(last.cast("date")))
    begin = F.concat(F.col("year"), F.lit("-01-01"))
    finish = F.concat(F.col("year"), F.lit("-12-31"))
    return years.withColumn("url", values_url(base, F.col(site), begin, finish))
