"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query's time is the median of $BENCH_REPEATS runs, after a run of all queries that counts
for none.
"""

import json
import os
import time
from statistics import median

from hydroframe import workload
from hydroframe.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def seconds(spark, query) -> float:
    """Median of the repeats; every row is computed, none is kept."""
    times = []
    for _ in range(REPEATS):
        start = time.perf_counter()
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - start)
    return median(times)


def main() -> None:
    spark = local_session(CPUS, "bench")
    for query in workload.QUERIES.values():  # warm up: compile and load what all queries share
        query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    times = {name: round(seconds(spark, query), 3) for name, query in workload.QUERIES.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "statistic": f"median of {REPEATS} after one run of all",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
