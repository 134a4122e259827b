"""Observations next to the descriptions of their series."""

import pytest

from hydroframe.operators import observations

ROWS = [("1_00060", float(n % 7)) for n in range(500)] + [("2_00010", 1.5), (None, 2.0), ("3_00095", None), ("9_99999", 3.0)]
NAMES = [("1_00060", "00060", "Discharge"), ("2_00010", "00010", None), (None, "00000", "no series")]
NAMES += [("3_00095", "00095", "first"), ("3_00095", "00095", "second"), ("4_00400", "00400", "unused")]


def joined(spark):
    rows = spark.createDataFrame(ROWS, "series string, value double")
    names = spark.createDataFrame(NAMES, "series string, parameter_cd string, description string")
    return observations.with_parameters(rows, names, ["series"])


@pytest.mark.parametrize("most, join", [(None, "BroadcastHashJoin"), (len(NAMES), "BroadcastHashJoin"), (1, "ShuffledHashJoin")])
def test_a_series_with_most_rows_is_not_sorted(spark, monkeypatch, capsys, most, join):
    if most is not None:
        monkeypatch.setattr(observations, "BROADCAST_ROWS", most)
    made = joined(spark)
    assert made.columns == ["series", "value", "parameter_cd", "description"]
    expected = [(s, v, p, d) for s, v in ROWS for k, p, d in NAMES if s is not None and s == k]
    assert sorted(map(tuple, made.collect()), key=repr) == sorted(expected, key=repr)
    made.explain()
    plan = capsys.readouterr().out
    assert join in plan and "Sort" not in plan
