"""Work per row or repetition that must not grow with the length of a series or be shuffled."""

import time

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
from axonlake.operators import resample as rs, series
from tests.test_join_plans import joins


def test_interpolation_of_a_long_gap(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select(F.col("id").alias("sample_id"), F.lit("s").alias("session_id"), F.lit("x").alias("signal"), (F.col("id") / 10).alias("t"), F.when((F.col("id") == 0) | (F.col("id") == n - 1), F.col("id").cast("double")).alias("value"))
    df.coalesce(1).write.parquet(f"{tmp_path}/samples.parquet")
    began = time.time()
    got = {r.sample_id: r.v for r in __spark_entry__.queries()["scl_interpolate"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 30  # quadratic: minutes
    assert got == {i: float(i) for i in range(1, n - 1)}


def test_draws_are_not_broadcast(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(9)], "k string, e long, v double")
    assert {kind for kind, on in joins(rs.bootstrap_mean(df, ["k"], "e", "v", 50)) if on in ("k, _i", "k, e")} == {"SortMergeJoin"}


def test_subset_means(spark):
    r = np.random.default_rng(2)
    rows = [(g, a, int(r.integers(0, 40)), i, float(r.normal()) if i % 7 else None) for g in (0, 1) for i, a in enumerate("aaabbbbcd" * 3)]
    df = spark.createDataFrame(rows, "g long, a string, k long, i long, v double")
    got = {(x.g, x.a): x for x in series.subset_means(df, "g", "a", "k", ["i"], "v", 210).collect()}
    assert len(got) == 8
    for (g, a), x in got.items():
        pool = [p for p in rows if p[0] == g]
        own = [p[4] for p in pool if p[1] == a]
        mean = np.mean([v for v in own if v is not None])
        null = []
        for rep in range(1, 211):
            o = sorted(pool, key=lambda p: (int(series.draws(p[2], rep)), p[2], p[3]))[: len(own)]
            null.append(np.mean([p[4] for p in o if p[4] is not None]))
        assert x.n == len(own) and abs(x.m - mean) < 1e-12
        assert abs(x.z - (mean - np.mean(null)) / np.std(null)) < 1e-9
        assert abs(x.p - (sum(abs(v) >= abs(mean) for v in null) + 1) / 211) < 1e-12
