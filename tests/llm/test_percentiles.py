import numpy as np
import pandas as pd
import pytest

from axonlake.llm import percentiles as pc

P = (0.0, 0.05, 0.5, 0.9, 1.0)


def frame(n=4000, seed=0):
    r = np.random.default_rng(seed)
    v = np.concatenate([r.lognormal(0, 3, n // 2), -r.lognormal(1, 1, n // 4), np.round(r.normal(0, 3, n // 4))])
    pdf = pd.DataFrame({"g": np.where(r.random(n) < 0.5, "hot", r.choice(list("abc"), n)), "d": r.integers(0, 4, n), "v": v, "_v": "clash", "lo": 1, "section": "x"})
    pdf.loc[:5, "v"] = [1e300, -1e300, 5e-324, 1e-300, 0.0, -0.0]
    pdf.loc[10:200:7, "v"] = np.nan
    pdf.loc[20:60, "g"] = None
    return pdf


def check(got, pdf, by):
    seen = 0
    for k, g in pdf.groupby(by, dropna=False):
        v = g.v.dropna()
        for p in P:
            if not len(v):
                continue
            key = tuple(None if x != x else x for x in (k if isinstance(k, tuple) else (k,)))
            r = got[(*key, p)]
            want = float(np.quantile(v, p))
            assert r.n == len(v) and abs(r.value - want) <= 1e-9 * max(1, abs(want)), (key, p, r, want)
            seen += 1
    assert seen == len(got)


@pytest.mark.parametrize("by", [["g"], ["g", "d"]])
@pytest.mark.parametrize("sections", [2, 64])
def test_exact(spark, by, sections):
    if sections == 2 and len(by) == 2:
        pytest.skip("plain halving once is enough")
    pdf = frame(1200 if sections == 2 else 4000)
    if sections == 2:
        pdf = pdf[pdf.v.abs().fillna(0) < 1e4]
    df = spark.createDataFrame(pdf.astype({"g": object}).where(pdf.notna(), None), "g string, d long, v double, _v string, lo long, section string")
    got = {(*[r[b] for b in by], r.percentile): r for r in pc.percentiles_by_bisection(df, by, "v", P, sections=sections).collect()}
    check(got, pdf, by)


def test_parts_add_up_and_bound(spark):
    pdf = frame()
    df = spark.createDataFrame(pdf.astype({"g": object}).where(pdf.notna(), None), "g string, d long, v double, _v string, lo long, section string")
    days = pc.summarise(df, ["g"], "v", ["d"])
    whole = pc.combine(days, ["g"])
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in pc.summarise(df, ["g"], "v").collect()}
    for r in pc.from_summary(whole, ["g"], (0.5,)).collect():
        v = pdf[pdf.g.isna() if r.g is None else pdf.g == r.g].v.dropna()
        m = float(np.quantile(v, 0.5))
        assert r.lower - 1e-9 <= m <= r.upper + 1e-9 and r.upper - r.lower <= 2 / pc.FINE * max(1, abs(m))
    got = {(r.g, r.percentile): r for r in pc.percentiles_by_bisection(df, ["g"], "v", P, summary=whole).collect()}
    check(got, pdf, ["g"])


def test_tolerance_infinities_and_empty(spark):
    df = spark.createDataFrame([("a", float(i) ** 2) for i in range(101)], "g string, v double")
    r = pc.percentiles_by_bisection(df, ["g"], "v", (0.5,), tolerance=500.0).first()
    assert r.lower <= 2500 <= r.upper and r.upper - r.lower <= 500
    inf = spark.createDataFrame([("a", x) for x in (float("-inf"), 1.0, 2.0, 3.0, float("inf"))], "g string, v double")
    got = {r.percentile: r.value for r in pc.percentiles_by_bisection(inf, ["g"], "v", (0.0, 0.5, 1.0)).collect()}
    assert got == {0.0: float("-inf"), 0.5: 2.0, 1.0: float("inf")}
    assert pc.percentiles_by_bisection(df.limit(0), ["g"], "v").count() == 0


@pytest.mark.parametrize("broadcast_rows,keep_part", [(0, 0.2), (20_000, 0.0), (0, 1.0)])
def test_plans_agree_on_narrow_columns(spark, broadcast_rows, keep_part):
    """Values far closer together than the first sections, by the salted merge join and by passes that only count."""
    r = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": np.where(r.random(3000) < 0.6, "hot", "b"), "d": 1, "v": 1000 + r.random(3000) * 1e-3})
    df = spark.createDataFrame(pdf)
    got = {(x.g, x.percentile): x for x in pc.percentiles_by_bisection(df, ["g"], "v", P, broadcast_rows=broadcast_rows, keep_part=keep_part).collect()}
    check(got, pdf, ["g"])


def test_unresolved_is_an_error(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1000)], "g string, v double")
    with pytest.raises(RuntimeError):
        pc.percentiles_by_bisection(df, ["g"], "v", (0.5,), sections=2, max_passes=1)
