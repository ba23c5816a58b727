"""Joins whose sides look small by the size of their files but are not must not be planned as broadcasts."""

import re

import pytest

import __spark_entry__


def joins(df):
    """Kind and keys of every planned join."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [(m[1], re.sub(r"#\d+L?", "", m[2])) for m in re.finditer(r"(\w+Join) \[(.*?)\]", plan)]


@pytest.mark.parametrize("name, keys", [("agg_peth_inflection", "session_id, _b"), ("join_nearest_grid", "session_id, unit_id")])
def test_not_broadcast(spark, data_dir, name, keys):
    kinds = {kind for kind, on in joins(__spark_entry__.queries()[name](spark, data_dir)) if on == keys}
    assert kinds == {"SortMergeJoin"}
