import numpy as np
import pandas as pd

from axonlake.operators.hotkeys import heavy_keys, weighted_profile


def test_against_pandas(spark):
    r = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({"a": np.where(r.random(n) < 0.6, "hot", r.choice(list("xyz"), n)), "b": r.choice(["p", "q"], n), "v": np.round(r.normal(0, 50, n), 1), "_w": "clash", "n": "clash", "_v": 1})
    pdf.loc[::17, "v"] = np.nan
    pdf.loc[::29, "a"] = None
    pdf.loc[5, "v"] = 1e12
    df = spark.createDataFrame(pdf.astype({"a": object}).where(pdf.notna(), None), "a string, b string, v double, _w string, n string, _v long")
    got = {(x.a, x.b): x for x in weighted_profile(df, ["a", "b"], "v", (0.1, 0.5, 0.999)).collect()}
    for (a, b), g in pdf.groupby(["a", "b"], dropna=False):
        x = got[None if a is np.nan or a is None or a != a else a, b]
        v = g.v.dropna()
        assert (x.n, x.n_values, x.n_distinct) == (len(g), len(v), v.nunique())
        counts = v.value_counts()
        assert x.mode == min(counts[counts == counts.max()].index)
        for q, name in ((0.1, "p10"), (0.5, "p50"), (0.999, "p99_9")):
            assert abs(x[name] - v.quantile(q)) < 1e-6 * max(1, abs(v.quantile(q)))


def test_share_and_empty(spark):
    df = spark.createDataFrame([("a", "b", 1.0)] * 98 + [("c", "d", None)] * 1 + [(None, "d", 1.0)] * 1, "k string, l string, v double")
    p = weighted_profile(df, ["k", "l"], "v")
    assert sorted(tuple(r) for r in heavy_keys(p, ["k", "l"], 0.01).collect()) == [("a", "b"), ("c", "d")]
    assert [tuple(r) for r in heavy_keys(p, ["k", "l"], 0.5).collect()] == [("a", "b")]
    assert weighted_profile(df.limit(0), ["k", "l"], "v").count() == 0
    zero = spark.createDataFrame([("a", 0.0), ("a", 0.0)], "k string, v double")
    assert weighted_profile(zero, ["k"], "v").first().p50 == 0.0
