"""Correlograms by blocks of units against every pair of spikes, and that no pair of spikes becomes a row."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from axonlake.operators import corr
from tests.test_join_plans import joins


@pytest.fixture(scope="module")
def spikes(spark):
    r = np.random.default_rng(3)
    rows = [(k, int(r.integers(0, 5)), int(t)) for k in ("x", "y") for t in r.integers(0, 4000, 120)]
    rows += rows[:9] + [("x", 7, rows[0][2]), ("x", 7, None), (None, 1, 5)]
    return rows, spark.createDataFrame(rows, "k string, u long, t_us long")


def brute(rows, edges, last):
    at, rows = Counter(), [r for r in rows if None not in r]
    for i, (k, a, s) in enumerate(rows):
        for j, (m, b, t) in enumerate(rows):
            if k == m and 0 <= t - s <= last and i != j and not (a == b and s == t and i > j):
                at[k, a, b, sum(e <= t - s for e in edges) - 1] += 1
    return at


@pytest.mark.parametrize("block, most", [(128, 1_000_000), (2, 1_000_000), (128, 30)])
def test_counts_of_all_pairs(spikes, block, most):
    rows, df = spikes
    edges = [0, 100, 250]
    want = brute(rows, edges, 400)
    half = {tuple(r)[:4]: r.n for r in corr.lag_counts(df, ["k"], "u", edges, 400, "half", block, most).collect()}
    assert half == want
    both = Counter()
    for (k, a, b, lag), n in want.items():
        both[k, a, b, lag] += n
        both[k, b, a, -lag] += n
    got = corr.lag_counts(df, ["k"], "u", edges, 400, "both", block, most)
    assert {tuple(r)[:4]: r.n for r in got.collect()} == both
    dense = {(r.k, r.unit_a, r.unit_b, i - 2): n for r in corr.lag_counts(df, ["k"], "u", edges, 400, "list", block, most).collect() for i, n in enumerate(r.counts) if n}
    assert dense == {p: n for p, n in both.items() if p[1] != p[2]}
    own = {(r.k, r.u, r.u, r.lag_bin): r.n for r in corr.autocorrelogram(df, ["k", "u"], 300, 100).collect()}
    want = Counter()
    for (k, a, b, lag), n in brute(rows, [0, 100, 200], 299).items():
        if a == b:
            want[k, a, a, lag] += n
            want[k, a, a, -lag] += n
    assert own == want


@pytest.mark.parametrize("block", [128, 3])
def test_found_as_from_rows(spark, block):
    r = np.random.default_rng(8)
    rows = [("x", u, int(t)) for u in range(6) for t in np.cumsum(r.integers(2_000, 60_000, 300))]
    rows += [("x", 9, t + 4_300) for _, u, t in rows if u == 1]
    df = spark.createDataFrame(rows, "k string, u long, t_us long")
    c = corr.correlogram(df, ["k"], "u", 101_000, 1_000).where("unit_a <> unit_b")
    want = sorted(tuple(x) for x in corr.sparse_interactions(c, ["k", "unit_a", "unit_b"], 100).collect())
    found = corr.lag_counts(df, ["k"], "u", list(range(0, 101_000, 1_000)), 100_999, "found", block)
    assert found.count() == c.select("unit_a", "unit_b").distinct().count()
    assert want and sorted(tuple(x) for x in found.where(F.col("lag_bin").isNotNull()).collect()) == want


@pytest.mark.parametrize("name", ["ccg_all", "ccg_log", "ccg_props", "ccg_norm", "ccg_centered", "cch_interactions", "flip_edges", "cmp_interaction_counts", "cmp_xcorr_area", "cmp_acg", "cch_pair"])
def test_spikes_are_not_joined(spark, data_dir, name):
    assert not [on for _, on in joins(__spark_entry__.queries()[name](spark, data_dir)) if "_b" in on]
