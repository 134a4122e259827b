"""The queries that SQL can express against it, and all of them by name."""

import re

import duckdb
import pytest

import __spark_entry__ as contract
from hydroframe.llm import workload
from tests.test_workload import SF_DIR, TYPES, duck, normal  # noqa: F401


@pytest.mark.parametrize("name", workload.SQL)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    got = workload.QUERIES[name](spark, SF_DIR)
    want = duck.execute(workload.SQL[name])
    wanted_types = {d[0]: TYPES[str(d[1])] for d in want.description}
    assert dict(got.dtypes) == wanted_types
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), list(wanted_types))


def test_every_operator_is_registered():
    names = contract.queries()
    assert "pipeline" in names
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14))
    assert set(contract.oracle_sql()) <= set(names)


def test_duckdb_reads_words_as_spark_does(spark):
    text = "a\u00a0b\x1cc d\x0be\x0c\rf \u3000 g\x85"
    pattern = r"[^\x20\x09-\x0D]+"
    want = duckdb.execute("select regexp_extract_all(?, ?)", [text, pattern]).fetchone()[0]
    assert want == [w.decode() for w in text.encode().split()]
