import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.functions import special
from axonlake.operators import fit, interval, resample as rs, stats


def test_special_functions():
    assert abs(special.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(special.chi2_upper(3.84, 1) - 0.0500435) < 1e-6
    assert abs(special.f_upper(4.0, 2, 10) - 1.8**-5) < 1e-9  # closed form for two degrees above
    assert abs(special.fisher_two_sided(8, 2, 1, 5) - 0.03496503) < 1e-7
    assert math.isnan(special.t_two_sided(1.0, 0))


def test_normal(spark):
    df = spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 1.96, 5.0)], "x double")
    got = df.select("x", special.norm_cdf(F.col("x")).alias("c"), special.norm_ppf(special.norm_cdf(F.col("x"))).alias("b")).collect()
    for r in got:
        assert abs(r.c - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-7
        assert abs(r.b - r.x) < 1e-2


def test_auc_by_pairs(spark):
    g = random.Random(4)
    rows = [("u", float(g.randrange(5)), g.random() < 0.4) for _ in range(60)] + [("one", 1.0, True), ("n", None, True), ("n", float("nan"), False)]
    df = spark.createDataFrame(rows, "k string, v double, c boolean")
    got = {r.k: r for r in stats.auc(df, ["k"], "v", F.col("c")).collect()}
    a = [v for k, v, c in rows if k == "u" and c]
    b = [v for k, v, c in rows if k == "u" and not c]
    want = sum((x > y) + 0.5 * (x == y) for x in a for y in b) / len(a) / len(b)
    assert abs(got["u"].auc - want) < 1e-12
    assert got["one"].auc is None and "n" not in got
    back = stats.auc(df.where("k = 'u'"), ["k"], "v", ~F.col("c")).first()
    assert abs(back.auc + want - 1) < 1e-12


def bh(p, by=False):
    m = len(p)
    o = np.argsort(p)
    q = p[o] * m / np.arange(1, m + 1) * (sum(1 / i for i in range(1, m + 1)) if by else 1)
    out = np.empty(m)
    out[o] = np.minimum(np.minimum.accumulate(q[::-1])[::-1], 1)
    return out


@pytest.mark.parametrize("method", ["bh", "by"])
def test_false_discovery(spark, method):
    r = np.random.default_rng(5)
    p = np.round(r.random(300) ** 3, 3)
    p[:40] = 1.0
    df = spark.createDataFrame([(i, "g", float(x)) for i, x in enumerate(p)] + [(999, "g", None), (998, "h", 0.04)], "i long, g string, p double")
    got = {x.i: (x.p_adj, x.reject) for x in stats.fdr(df, ["g"], "p", method).collect()}
    want = bh(p, method == "by")
    assert all(abs(got[i][0] - want[i]) < 1e-9 for i in range(300)) and got[999] == (None, False) and got[998] == (0.04, True)


def test_intervals_against_numpy(spark):
    r = np.random.default_rng(6)
    t = np.sort(r.integers(0, 100_000, 400))
    e = r.integers(0, 100_000, 30)
    p = spark.createDataFrame([("s", "u", int(x)) for x in t] + [("s", "u", None)], "k string, u string, t_us long")
    ev = spark.createDataFrame([("s", i, int(x)) for i, x in enumerate(e)], "k string, event_id long, at_us long")
    units = spark.createDataFrame([("s", "u"), ("s", "silent"), ("z", "other")], "k string, u string")
    for closed, side in (("left", "left"), ("both", "right")):
        c = interval.count_in_window(p, units, ev, ["k"], ["u"], ["event_id"], -500, 1500, closed)
        got = {(x.u, x.event_id): x.n for x in c.collect()}
        for i, x in enumerate(e):
            assert got["u", i] == np.searchsorted(t, x + 1500, side) - np.searchsorted(t, x - 500, "left") and got["silent", i] == 0
        assert len(got) == 60


def test_nearest_earlier_wins(spark):
    a = spark.createDataFrame([("s", 3, "x"), ("s", 10, "y"), ("t", 1, "z")], "k string, t long, name string")
    b = spark.createDataFrame([("s", 2, 20), ("s", 4, 40)], "k string, r long, v long")
    got = {r.name: (r.match_t, r.v) for r in interval.nearest(a, b, ["k"], "t", "r", "v").collect()}
    assert got == {"x": (2, 20), "y": (4, 40), "z": (None, None)}
    assert {r.name: r.v for r in interval.nearest(a, b, ["k"], "t", "r", "v", "forward").collect()} == {"x": 40, "y": None, "z": None}


def test_refractory_is_the_greedy_fold(spark):
    r = np.random.default_rng(7)
    t = sorted(set(r.integers(0, 5000, 300).tolist()))
    kept, last = [], None
    for x in t:
        if last is None or x - last > 60:
            kept.append(x)
            last = x
    df = spark.createDataFrame([("a", x) for x in t], "k string, t_us long")
    assert sorted(x.t_us for x in interval.refractory(df, ["k"], 60).collect()) == kept
    assert interval.refractory(df.limit(0), ["k"], 60).count() == 0


def test_shift_test_is_calibrated(spark):
    r = np.random.default_rng(8)
    rows = []
    for u in range(150):
        a, b = np.cumsum(r.normal(size=120)), np.cumsum(r.normal(size=120))
        rows += [(u, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    s = rs.shift_test(spark.createDataFrame(rows, "u long, i long, x double, y double"), ["u"], "i", "x", "y", 19).toPandas()
    assert (s.p_conservative >= s.p_approx - 1e-12).all()
    assert (s.p_conservative <= 0.1).mean() <= 0.16


def test_permutation_is_repeatable(spark):
    e = spark.createDataFrame([(i, i % 2) for i in range(10)], "k long, g int")
    a = sorted(tuple(r) for r in rs.permuted_labels(e, [], "k", "g", 20).collect())
    b = sorted(tuple(r) for r in rs.permuted_labels(e.repartition(7), [], "k", "g", 20).collect())
    assert a == b and len(a) == 210
    assert len({tuple(g for _, rep, g in a if rep == k) for k in range(1, 21)}) > 10
    assert all(sum(g for _, rep, g in a if rep == k) == 5 for k in range(21))


def test_bootstrap_keeps_multiplicity(spark):
    e = spark.createDataFrame([("g", i, float(i)) for i in range(12)], "g string, k long, v double")
    d = rs.bootstrap_draws(e, ["g"], "k", 30).groupBy("rep").agg(F.sum("times").alias("n")).collect()
    assert len(d) == 30 and all(r.n == 12 for r in d)
    ci = rs.bootstrap_mean(e, ["g"], "k", "v", 100).first()
    assert ci.low < ci.mean < ci.high


def test_kernels():
    t = np.arange(60.0)
    p, rss = fit.fit_sigmoid(t, fit.sigmoid(t, 1, 3, 30, 0.5))
    assert rss < 1e-6 and abs(p[2] - 30) < 0.1
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(0, 1, 400), r.normal(8, 1, 400)])
    g = fit.two_gaussians(x)
    assert g["valid"] and 3 < g["threshold"] < 5
    assert fit.lz76("0" * 30) < fit.lz76("0110100110010110100101100110")
    z = np.hstack([np.ones((500, 1)), r.normal(size=(500, 1))])
    w = fit.poisson_fit(z, r.poisson(np.exp(z @ [0.5, 0.8])))
    assert np.abs(w - [0.5, 0.8]).max() < 0.15


def test_coupled_units_reach_significance(spark):
    """Full-size shift test: a unit that follows the behaviour is found at 0.05, unrelated random walks rarely."""
    r = np.random.default_rng(11)
    rows = []
    for u in range(60):
        b = np.cumsum(r.normal(size=140))
        a = (b + r.normal(size=140)) if u < 20 else np.cumsum(r.normal(size=140))
        rows += [(u, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "u long, i long, x double, y double")
    for score in ("pearson", "spearman"):
        s = rs.shift_test(df, ["u"], "i", "x", "y", score=score).toPandas()
        assert (s.n_shifts == 39).all() and (s.n_rows == 62).all()
        assert (s[s.u < 20].p_approx < 0.05).mean() > 0.8 and (s[s.u >= 20].p_approx < 0.05).mean() < 0.2
    own = rs.shift_test(df, ["u"], "i", "x", "y", score=lambda x, y: x @ y).toPandas()
    assert own.r.notna().all()


def test_shift_test_against_plain_loops(spark):
    r = np.random.default_rng(12)
    series_ = {u: (r.normal(size=n), r.normal(size=n), r.normal(size=n)) for u, n in ((1, 30), (2, 9), (3, 11), (4, 100))}
    series_[5] = (np.ones(40), r.normal(size=40), r.normal(size=40))
    df = spark.createDataFrame([(u, i, float(a[i]), float(b[i]), float(c[i])) for u, (a, b, c) in series_.items() for i in range(len(a))] + [(1, 99, None, 1.0, 1.0)], "u long, i long, x double, y double, z double")
    plain = {x.u: x for x in rs.shift_test(df, ["u"], "i", "x", "y").collect()}
    given = {x.u: x for x in rs.shift_test(df, ["u"], "i", "x", "y", given="z", alternative="greater").collect()}
    for u, (a, b, c) in series_.items():
        n = min(39, (len(a) - 8) // 2)
        if n < 1 or u == 5:
            assert plain[u].r is None and plain[u].p_approx == 1.0 and plain[u].n_shifts == max(n, 0)
            continue
        mid = slice(n, len(a) - n)
        at = lambda k, a=a, n=n: a[n + k : len(a) - n + k]
        rr = [np.corrcoef(at(k), b[mid])[0, 1] for k in range(-n, n + 1)]
        assert abs(plain[u].r - rr[n]) < 1e-9 and plain[u].m == sum(abs(x) >= abs(rr[n]) - 1e-9 for x in rr)
        z = np.vstack([np.ones(len(b[mid])), c[mid]]).T
        left = lambda v, z=z: v - z @ np.linalg.lstsq(z, v, rcond=None)[0]
        pr = [np.corrcoef(left(at(k)), left(b[mid]))[0, 1] for k in range(-n, n + 1)]
        assert abs(given[u].r - pr[n]) < 1e-9 and given[u].m == sum(x >= pr[n] - 1e-9 for x in pr)


def test_bootstrap_of_cells_matches_drawing_neurons(spark):
    from axonlake.operators import series

    r = np.random.default_rng(13)
    mouse, area = r.integers(0, 6, 600), r.integers(0, 4, 600)
    hit = r.random(600) < 0.1 + 0.2 * area
    df = spark.createDataFrame([("g", int(m), f"a{a}", int(h), 1) for m, a, h in zip(mouse, area, hit)], "reward_group string, mouse long, area string, k int, n int")

    def focal(idx):
        p = np.array([hit[idx][area[idx] == a].mean() if (area[idx] == a).any() else 0.0 for a in range(4)])
        return (p * p).sum() / p.sum() ** 2

    flat = [focal(r.integers(0, 600, 600)) for _ in range(3000)]
    by = [np.flatnonzero(mouse == m) for m in range(6)]
    deep = [focal(np.concatenate([r.choice(by[m], len(by[m])) for m in r.integers(0, 6, 6)])) for _ in range(3000)]
    for entity, want in ((None, flat), ("mouse", deep)):
        got = series.focality_bootstrap(df, "reward_group", entity, 10_000).first()
        assert got.n_rep == 10_000 and abs(got.focality - focal(np.arange(600))) < 1e-12
        assert abs(got.low - np.quantile(want, 0.025)) < 0.004 and abs(got.high - np.quantile(want, 0.975)) < 0.004
    assert series.focality_bootstrap(df.limit(0), "reward_group", None).count() == 0


def test_refractory_and_nearest_do_not_depend_on_buckets(spark):
    r = np.random.default_rng(21)
    rows = [(k, int(x)) for k in ("a", "b", None) for x in np.cumsum(r.integers(0, 30, 300)) - 2000]
    df = spark.createDataFrame(rows, "k string, t_us long")
    want = []
    for k in ("a", "b", None):
        last = None
        for x in sorted({x for kk, x in rows if kk == k}):
            if last is None or x - last > 60:
                want.append((k, x))
                last = x
    for bucket in (None, 61, 150, 1000):
        assert sorted((tuple(x) for x in interval.refractory(df, ["k"], 60, bucket=bucket).collect()), key=str) == sorted(want, key=str)
    left = spark.createDataFrame([("a", i, int(x)) for i, x in enumerate(r.integers(-4000, 9000, 200))] + [("a", 900, None), ("zz", 901, 5), (None, 902, 5)], "k string, i long, t long")
    right = spark.createDataFrame([("a", int(x), i) for i, x in enumerate(r.integers(-2000, 5000, 40))] + [(None, 7, 77)], "k string, r long, v int")
    hits = [(x.r, x.v) for x in right.collect() if x.k == "a"]
    for bucket in (50, 1000, 600_000_000):
        got = {x.i: (x.match_t, x.v) for x in interval.nearest(left, right, ["k"], "t", "r", "v", bucket=bucket).collect()}
        assert got[900] == (None, None) and got[901] == (None, None) and got[902] == (7, 77)
        for x in left.where("i < 900").collect():
            best = min(hits, key=lambda h: (abs(h[0] - x.t), h[0], h[1]))  # noqa: B023
            assert got[x.i] == best


def test_mixture_of_any_size(spark):
    """The threshold from counted ranges is that of the values themselves, with an extreme value and above any size."""
    r = np.random.default_rng(31)
    x = np.concatenate([r.normal(0, 1, 20_000), r.normal(6, 1, 10_000), [1e6]])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0)] * 20 + [(None, float(v)) for v in x[:50]] + [("a", None), ("a", float("nan"))], "g string, v double")
    got = {q.g: q for q in fit.mixture_threshold(df.where("v < 1e5 or v is null"), ["g"], "v").collect()}
    want = fit.two_gaussians(x[:-1])
    assert set(got) == {"a", None} and got["a"].n == 30_000 and got["a"].valid
    assert abs(got["a"].threshold - want["threshold"]) < 0.02 and abs(got["a"].m1 - want["m1"]) < 0.02
    assert fit.mixture_threshold(df, ["g"], "v").where("g = 'a'").first().n == 30_001
