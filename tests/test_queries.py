"""Every core query against its SQL on the smallest test tables; queries without SQL must run and keep their columns."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from axonlake import plans
from axonlake.session import table_names

QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def duck(data_dir):
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in table_names:
        if os.path.exists(f"{data_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{data_dir}/{t}.parquet'")
    return c


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("NaT", "<NA>", "nan"):
        return "~"
    if str(x) in ("True", "False"):
        return str(x)
    try:
        return "%.5g" % (float(x) + 0.0)
    except (TypeError, ValueError):
        return str(x).removesuffix(" 00:00:00")


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, data_dir, name):
    got, want = table(QUERIES[name](spark, data_dir).toPandas()), table(duck.execute(ORACLE[name]).df())
    spark.catalog.clearCache()
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    different = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not different, different[:3]


#: Repetitions that a result must report; permutations in which a group is empty count in none.
REPETITIONS = {"cmp_xcorr_trial": 1000, "res_boot_hier": 10_000, "res_boot_pct": 10_000, "res_permanova_mv": 9999}
#: On the smallest tables, whose sessions are few and short, these may find nothing.
MAY_BE_EMPTY = {"res_permanova_mv", "fit_aic3", "cmp_inflection_session", "fit_poisson", "cmp_shift_run", "cch_pipeline", "cmp_inflection_lag", "cmp_area_pvals", "stat_kruskal", "res_boot_bca", "res_perm_omnibus", "cmp_region_worker", "res_region_all", "res_perm_region", "fit_gmm", "cmp_waveform_old"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, data_dir, name):
    """Queries without SQL: rows come out, and what must hold of their values holds."""
    df = QUERIES[name](spark, data_dir)
    got = df.toPandas()
    spark.catalog.clearCache()
    assert list(got.columns) == df.columns and (len(got) or name in MAY_BE_EMPTY)
    for c in got.columns:
        if c in ("p", "p_adj", "p_pos", "p_neg", "p_approx", "p_conservative", "p_welch", "p_mwu", "p_noise", "confidence"):
            assert got[c].dropna().between(0, 1).all(), c
        if c in ("r", "test_corr", "train_corr"):
            assert got[c].dropna().abs().le(1 + 1e-9).all(), c
    if {"low", "high"} <= set(got.columns):
        assert (got.low <= got.high + 1e-12)[got.low.notna()].all()
    if {"p", "p_adj"} <= set(got.columns):
        assert (got.p_adj >= got.p - 1e-12)[got.p_adj.notna()].all()
    if name in REPETITIONS:
        assert (got.n_rep == REPETITIONS[name]).all()
