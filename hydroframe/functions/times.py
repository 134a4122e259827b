"""Date texts of requests and lifetimes of stored tables."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = "yyyy-MM-dd"

# Seconds per lifetime unit.
UNIT_SECONDS = {
    "d": 86400, "day": 86400, "days": 86400,
    "h": 3600, "hour": 3600, "hours": 3600,
    "min": 60, "m": 60, "minute": 60, "minutes": 60,
    "s": 1, "sec": 1, "second": 1, "seconds": 1,
    "w": 604800,
}


def lifetime_seconds(text: str) -> int:
    """Seconds in a lifetime such as `1D`, `1H`, `90min` or `1D 12h`."""
    total = 0.0
    rest = text.strip()
    while rest:
        part = re.match(r"([0-9]+(?:\.[0-9]+)?)\s*([A-Za-z]+)\s*", rest)
        if part is None or part[2].lower() not in UNIT_SECONDS:
            raise ValueError(f"not a lifetime: {text!r}")
        total += float(part[1]) * UNIT_SECONDS[part[2].lower()]
        rest = rest[part.end():]
    if not text.strip():
        raise ValueError("empty lifetime")
    return int(total)


def lifetime(text: str) -> Column:
    """The lifetime as an interval column."""
    return F.make_dt_interval(secs=F.lit(float(lifetime_seconds(text))))


def day_text(moment: Column) -> Column:
    return F.date_format(moment, DAY)


def safe_day_text(text: Column) -> Column:
    """The day of a date text, or an empty string where it cannot be read."""
    return F.coalesce(day_text(text.try_cast("timestamp_ntz")), F.lit(""))


def moment(text: Column, run_ts: Column) -> Column:
    """The moment a date text names; an empty text means the time of the run."""
    return F.when(text == "", run_ts.cast("timestamp_ntz")).otherwise(
        text.try_cast("timestamp_ntz")
    )


def year_of(text: Column, run_ts: Column) -> Column:
    return F.year(moment(text, run_ts))


def ordered_days(start: Column, end: Column, run_ts: Column) -> tuple[Column, Column]:
    """Both date texts as day texts, earlier one first; null if either is no date."""
    first, second = moment(start, run_ts), moment(end, run_ts)
    both = first.isNotNull() & second.isNotNull()
    return (
        F.when(both, day_text(F.least(first, second))),
        F.when(both, day_text(F.greatest(first, second))),
    )
