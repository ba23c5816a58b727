import numpy as np
from pyspark.sql import functions as F

from axonlake.functions import labels
from axonlake.operators import corr, hist, interval, relational as rel


def test_last_bin_is_closed_like_numpy(spark):
    x = [0, 5, 10, 19, 20, 29, 30, 31, -1]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x long")
    got = [r.n for r in df.withColumn("b", hist.fixed_bins(F.col("x"), 0, 30, 10)).where("b is not null").groupBy("b").agg(F.count("*").alias("n")).orderBy("b").collect()]
    assert got == np.histogram(x, bins=[0, 10, 20, 30])[0].tolist()


def session(spark, seed=0):
    r = np.random.default_rng(seed)
    spikes = [("s", u, int(t)) for u in range(4) for t in r.integers(0, 60_000_000, 150)]
    events = [("s", i, int(t), "ab"[i % 2]) for i, t in enumerate(r.integers(2_000_000, 55_000_000, 12))]
    units = [("s", u) for u in range(5)]
    return spark.createDataFrame(spikes, "k string, u long, t_us long"), spark.createDataFrame(units, "k string, u long"), spark.createDataFrame(events, "k string, event_id long, at_us long, cond string")


def test_mean_histogram_equals_the_mean_of_trials(spark):
    p, u, e = session(spark)
    single = hist.peth(p, u, e.select("k", "event_id", "at_us"), ["k"], ["u"], ["event_id"], -1_000_000, 2_000_000, 500_000)
    want = {(r.u, r.cond, r.bin): (r.m, r.s) for r in single.join(e, ["k", "event_id"]).groupBy("u", "cond", "bin").agg((F.avg("n") / 0.5).alias("m"), (F.stddev_pop("n") / F.sqrt(F.count("*")) / 0.5).alias("s")).collect()}
    got = {(r.u, r.cond, r.bin): (r.rate, r.sem) for r in hist.mean_peth(p, u, e, ["k"], ["u"], ["cond"], -1_000_000, 2_000_000, 500_000).collect()}
    assert got.keys() == want.keys() and len(got) == 5 * 2 * 6
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    assert single.agg(F.sum("n")).first()[0] == interval.range_join(p, e, ["k"], -1_000_000, 2_000_000).count()


def test_bucket_width_does_not_matter(spark):
    p, _, e = session(spark, 1)
    rows = [sorted(map(tuple, interval.range_join(p, e, ["k"], -700_000, 900_000, bucket=b).collect())) for b in (None, 10_000, 50_000_000)]
    assert rows[0] == rows[1] == rows[2] and rows[0]


def test_filters_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=40)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i long, v double")
    get = lambda d: np.array([r.smooth for r in d.orderBy("i").collect()])
    w = hist.weights_gauss(1.5, 4, True)
    assert np.allclose(get(hist.fir(df, ["k"], "i", "v", w, 0)), np.convolve(x, w)[:40])
    assert np.allclose(get(hist.moving_average(df, ["k"], "i", "v", 2))[5], x[3:8].mean())
    sg = hist.savgol_weights(7, 2)
    line = spark.createDataFrame([("a", i, 2.0 * i + 0.1 * i * i) for i in range(20)], "k string, i long, v double")
    assert np.allclose(get(hist.fir(line, ["k"], "i", "v", sg, -3))[5:15], [2.0 * i + 0.1 * i * i for i in range(5, 15)])


def test_correlogram_is_symmetric_and_counts_pairs(spark):
    p, _, _ = session(spark, 3)
    c = {(r.unit_a, r.unit_b, r.lag_bin): r.n for r in corr.correlogram(p.unionByName(p.limit(3)), ["k"], "u", 200_000, 20_000).collect()}
    assert c and all(c[b, a, -k] == n for (a, b, k), n in c.items())
    rows = sorted((r.t_us, r.u) for r in p.unionByName(p.limit(3)).collect())
    want = sum(1 for i, (t, u) in enumerate(rows) for s, v in rows[i + 1 :] if u != v and 0 <= s - t < 200_000)
    off = sum(n for (a, b, k), n in c.items() if a != b and k > 0) + sum(n for (a, b, k), n in c.items() if a != b and k == 0) / 2
    ties = sum(1 for i, (t, u) in enumerate(rows) for s, v in rows[i + 1 :] if u != v and s == t)
    assert off == want + ties


def test_pairs_audit_and_runs(spark):
    d = spark.createDataFrame([("m", 1, "x"), ("m", 2, "x"), ("m", 3, "y"), ("m", 3, "y"), ("n", 1, "x"), (None, 9, None)], "g string, i long, a string")
    assert sorted((r.id_a, r.id_b) for r in rel.pairs(d, ["g"], "i").collect()) == [(1, 2), (1, 3), (2, 3)]
    assert sorted((r.id_a, r.id_b) for r in rel.pairs(d, ["g"], "i", same=["a"]).collect()) == [(1, 2)]
    a = {r.i: (r.n_left, r.n_right, r.side) for r in rel.outer_audit(d.where("g = 'm'"), d.where("g = 'n' or i = 9"), ["i"]).collect()}
    assert a == {1: (1, 1, "both"), 2: (1, 0, "left_only"), 3: (2, 0, "left_only"), 9: (0, 1, "right_only")}
    f = spark.createDataFrame([("k", i, c == "1") for i, c in enumerate("0111011110")], "k string, i long, f boolean")
    got = "".join("1" if r.in_run else "0" for r in rel.runs(f, ["k"], ["i"], F.col("f"), 4).orderBy("i").collect())
    assert got == "0000011110"


def test_one_to_one_fails_on_repeats(spark):
    import pytest

    a = spark.createDataFrame([(1,), (2,)], "i long")
    assert rel.one_to_one(a, a.withColumn("v", F.col("i")), ["i"]).count() == 2
    with pytest.raises(Exception, match="repeats a key"):
        rel.one_to_one(a, a.unionByName(a).withColumn("v", F.col("i")), ["i"]).collect()


def test_labels(spark):
    df = spark.createDataFrame([("SSp-bfd2/3", "imec12"), ("CA1", "x"), ("MOs6a", "imec0"), (None, None)], "a string, p string")
    a = F.col("a")
    got = [tuple(r) for r in df.select(labels.layer(a), labels.layer_number(a), labels.without_layer(a), labels.layer_group(a), labels.probe_number(F.col("p"))).collect()]
    assert got == [("2/3", 2, "SSp-bfd", "superficial", 12), (None, None, "CA1", "none", None), ("6a", 6, "MOs", "deep", 0), (None, None, None, "none", None)]
    t = spark.createDataFrame([("{'area': 'wS1', side: left}",), ("{}",), ("nonsense",), (None,)], "t string")
    assert [r[0] for r in t.select(labels.location_map(F.col("t"))).collect()][0] == {"area": "wS1", "side": "left"}
    n = spark.createDataFrame([("[1 2.5\n 3e-1]",), ("[]",), ("[a, 2]",), (None,)], "t string")
    assert [r[0] for r in n.select(labels.parse_numbers(F.col("t"))).collect()] == [[1.0, 2.5, 0.3], [], [None, 2.0], None]


def test_whole_bin_means_keep_every_sample_of_a_long_recording(spark):
    x = [("s", t + 0.5, float(t)) for t in (0, 1, 75, 5000, 9999)] + [("s", 75.6, float("nan")), ("s", None, 1.0), (None, 500.0, 4.0), (None, 502.9, None)]
    df = spark.createDataFrame(x, "k string, t double, v double")
    got = {(r.k, r.bin): (r["mean"], r.n) for r in hist.bin_means_whole(df, ["k"], "t", "v", 1.0).collect()}
    assert len(got) == 10_000 + 3 and sum(n for _, n in got.values()) == 6
    assert got["s", 9999] == (9999.0, 1) and got["s", 75] == (75.0, 1) and got["s", 2] == (0.0, 0)
    assert got[None, 500] == (4.0, 1) and got[None, 501] == got[None, 502] == (0.0, 0)


def test_whole_bin_means_query_counts_every_sample(spark, data_dir):
    from axonlake import plans
    from axonlake.session import read_table

    fine = read_table(spark, data_dir, "samples").distinct().where("t is not null and not isnan(t) and value is not null and not isnan(value)").count()
    assert plans.queries()["agg_bin_mean"](spark, data_dir).agg(F.sum("n")).first()[0] == fine


def coupled(spark):
    """Unit 1 follows 400 of the 12,000 spikes of unit 0 after 5.3 ms; unit 2 is on its own."""
    r = np.random.default_rng(4)
    a, b, c = r.integers(1_000_000, 600_000_000, (3, 12_000))
    t = {0: a, 1: np.concatenate([b, a[:400] + 5_300]), 2: c}
    return spark.createDataFrame([("x", u, int(v)) for u, x in t.items() for v in x], "k string, u long, t_us long"), t


def test_interactions_at_a_few_milliseconds_are_found(spark):
    p, t = coupled(spark)
    later = np.sort(t[1])
    n = int((np.searchsorted(later, t[0] + 6_000) - np.searchsorted(later, t[0] + 5_000)).sum())
    c = corr.correlogram(p, ["k"], "u", 101_000, 1_000).where("unit_a <> unit_b")
    assert [tuple(r) for r in corr.sparse_interactions(c, ["k", "unit_a", "unit_b"], 100).collect()] == [("x", 0, 1, 5, n, "excitatory")]
    peaks = []
    for block in (1, 64):
        r = corr.dithered(p, "k", "u", "found", block=block).collect()
        assert [(x.k, x.unit_a, x.unit_b, x.lag_bin, x.kind) for x in r] == [("x", 0, 1, 5, "excitatory")]
        peaks.append(r[0].peak)
    assert peaks[0] == peaks[1] and 300 < peaks[0] < 460


def test_dithered_mean_counts_every_surrogate(spark):
    p = spark.createDataFrame([("x", 0, 1_000_000), ("x", 1, 1_005_500)], "k string, u long, t_us long")
    got = {(r.unit_a, r.lag_bin): r.jittered for r in corr.dithered(p, "k", "u", "mean").collect()}
    assert abs(sum(got.values()) - 2) < 1e-9 and all(got[1, -k] == v for (u, k), v in got.items() if u == 0)
    assert all(-5 < k < 16 for u, k in got if u == 0) and len(got) > 20
    assert {r.lag_bin for r in corr.dithered(p, "k", "u", "mean", dither=0).collect()} == {5, -5}


def test_registered_correlograms_have_the_bins_of_a_millisecond(spark, data_dir):
    from axonlake import plans

    lags = [r.lag_bin for r in plans.queries()["cch_jitter"](spark, data_dir).select("lag_bin").distinct().collect()]
    assert (min(lags), max(lags), len(lags)) == (-100, 100, 201)
