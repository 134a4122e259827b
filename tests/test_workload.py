"""Every query against its SQL on the small test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from hydroframe import workload

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double",
    "TIMESTAMP": "timestamp_ntz", "DATE": "date", "BOOLEAN": "boolean",
}


def normal(rows, columns: list[str]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", workload.QUERIES)
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF_DIR)
    want = duck.execute(contract.oracle_sql()[name])
    wanted_types = {d[0]: TYPES[str(d[1])] for d in want.description}
    assert dict(got.dtypes) == wanted_types
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), list(wanted_types))


def test_entry(spark):
    assert contract.entry(spark).count() > 0
