"""Fits, rank tests and unit quality against plain versions."""

import math

import numpy as np
from pyspark.sql import functions as F

from axonlake.operators import corr, fit, quality, resample as rs, stats


def test_kruskal_against_plain_ranks(spark):
    r = np.random.default_rng(1)
    rows = [("k", f"g{int(g)}", float(np.round(v, 1))) for g, v in zip(r.integers(0, 3, 90), r.normal(0, 1, 90))]
    rows = [(k, g, v + (0.8 if g == "g2" else 0)) for k, g, v in rows] + [("k", None, 1.0), ("k", "g1", None), ("k", "g1", float("nan"))]
    got = stats.kruskal(spark.createDataFrame(rows, "k string, g string, v double"), ["k"], "g", "v").first()
    x = [(g, v) for _, g, v in rows if g is not None and v is not None and v == v]
    v = np.array([b for _, b in x])
    rank = np.array([(v < b).sum() + ((v == b).sum() + 1) / 2 for b in v])
    n = len(v)
    groups = {g: rank[[i for i, (a, _) in enumerate(x) if a == g]] for g in {a for a, _ in x}}
    ties = sum(c**3 - c for c in np.unique(v, return_counts=True)[1])
    h = (12 / (n * (n + 1)) * sum(q.sum() ** 2 / len(q) for q in groups.values()) - 3 * (n + 1)) / (1 - ties / (n**3 - n))
    assert got.n == n and got.n_groups == 3 and abs(got.h - h) < 1e-9
    assert abs(got.p - math.exp(-h / 2)) < 1e-9  # chi-square with two degrees of freedom


def test_residuals_have_no_condition_mean(spark):
    df = spark.createDataFrame([("a", i % 2, float(i)) for i in range(11)] + [("b", 0, None)], "u string, c int, v double")
    x = corr.residuals(df, ["u", "c"], "v")
    assert all(abs(r.s) < 1e-9 for r in x.where("u = 'a'").groupBy("c").agg(F.sum("residual").alias("s")).collect())
    assert x.where("u = 'b'").first().residual is None


def test_artifacts_are_replaced_at_the_base_rate(spark):
    """Every spike of the window goes; what comes in has the mean of the base rate, also far above 30 spikes, and is repeatable."""
    rows, events = [], []
    for e in range(120):
        t0 = e * 10_000_000
        events.append(("s", e, t0))
        for u, n in ((1, 50), (2, 600)):  # expected in the window: 5 and 60
            rows += [("s", u, t0 - 1_000_000 + i * (1_000_000 // n)) for i in range(n)]
            rows += [("s", u, t0 + i * 10_000) for i in range(10)]
    p = spark.createDataFrame(rows, "session_id string, unit_id long, t_us long").distinct()
    e = spark.createDataFrame(events, "session_id string, event_id long, at_us long")
    args = (p, e, ["session_id"], "unit_id", 0, 100_000, -1_000_000)
    got = rs.replace_artifact(*args)
    inside = got.withColumn("r", F.pmod("t_us", F.lit(10_000_000))).where("r < 100000").groupBy("unit_id").agg((F.count("*") / 120).alias("m")).collect()
    mean = {r.unit_id: r.m for r in inside}
    assert abs(mean[1] - 5) < 0.7 and abs(mean[2] - 60) < 2.5
    outside = lambda d: d.where(F.pmod("t_us", F.lit(10_000_000)) >= 100_000).count()
    assert outside(got) == outside(p)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rs.replace_artifact(*args).collect()))


def test_poisson_fits_find_the_rates(spark):
    r = np.random.default_rng(2)
    rows = []
    for u, (a, b) in enumerate([(0.5, 0.8), (1.0, -0.5), (0.2, 0.0)]):
        x = r.normal(size=600)
        rows += [("s", u, i, float(x[i]), float(r.normal()), int(r.poisson(math.exp(a + b * x[i]))), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "session_id string, unit_id long, event_id long, x double, z double, n int, fold int")
    got = fit.fit_units(df, ["session_id", "unit_id"], "n", ["x", "z"], "fold", "poisson").toPandas()
    full, less = got[got.model_name == "full"].set_index(["unit_id", "fold"]), got[got.model_name == "no_x"].set_index(["unit_id", "fold"])
    assert (full.loc[0].test_score > less.loc[0].test_score + 0.05).all() and (full.loc[1].test_score > less.loc[1].test_score + 0.02).all()
    assert ((full.loc[2].test_score - less.loc[2].test_score).abs() < 0.03).all()


def test_unit_scores_and_flags(spark):
    """A regular train passes, a bursting one with violations and a silent one are judged by hand-computed scores."""
    good = [i * 50_000 + (i % 7) * 3_000 for i in range(400)]
    bad = sorted([i * 200_000 for i in range(100)] + [i * 200_000 + 1_000 for i in range(100)])
    units = spark.createDataFrame([("s", 1, [0.0, -50.0, 20.0], 0.9), ("s", 2, [0.0, -0.2, 0.1], 0.1), ("s", 3, None, None)], "session_id string, unit_id long, waveform_mean array<double>, presenceRatio double")
    spikes = spark.createDataFrame([("s", 1, t) for t in good] + [("s", 2, t) for t in bad], "session_id string, unit_id long, t_us long")
    q = {r.unit_id: r for r in quality.score_units(quality.unit_features(units, spikes, ["session_id", "unit_id"]), ["session_id", "unit_id"]).collect()}
    isi = np.diff(bad)
    assert abs(q[2].score_isi_violation - (isi < 2000).mean()) < 1e-12 and abs(q[2].score_isi_cv - isi.std() / isi.mean()) < 1e-9
    assert q[2].flag_isi_violation and q[2].flag_burst and q[2].flag_amplitude and q[2].flag_presence and q[2].is_noise
    assert not q[1].flag_rate and not q[1].flag_isi_violation and not q[1].flag_amplitude and not q[1].is_noise
    assert q[3].n_flags == 0 and not q[3].is_noise
    one = quality.score_units(quality.unit_features(units, spikes, ["session_id", "unit_id"]), ["session_id", "unit_id"], [quality.Metric("own", F.col("n_spikes").cast("double"), 250.0)], 1)
    assert {r.unit_id: r.is_noise for r in one.collect()} == {1: False, 2: True, 3: True}


def test_forest_tells_held_out_rows(spark):
    r = np.random.default_rng(3)
    y = r.integers(0, 2, 600)
    rows = [(i, float(r.normal(2.5 * k, 1)), float(r.normal()) if r.random() > 0.1 else None, float(k)) for i, k in enumerate(y)]
    df = spark.createDataFrame(rows, "i long, a double, b double, y double")
    m = fit.forest(df.where("i % 2 = 0"), ["a", "b"], "y", trees=10)
    best = 0.5 * (1 + math.erf(1.25 / math.sqrt(2)))  # what the true threshold between the two classes gets right
    assert m.transform(df.where("i % 2 = 1")).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0] > best - 0.07


def test_phrases_of_a_sequence():
    """Lempel-Ziv phrases by the definition: the shortest piece that did not occur before its own end."""
    def plain(s):
        i, c = 0, 0
        while i < len(s):
            k = next((k for k in range(1, len(s) - i + 1) if s.find(s[i : i + k], 0, i + k - 1) < 0), len(s) - i)
            i, c = i + k, c + 1
        return c

    r = np.random.default_rng(4)
    for n in (0, 1, 2, 17, 60):
        s = "".join(r.choice(list("01"), n))
        assert fit.lz76(s) == plain(s)
