"""Per-group statistics from value counts: AUC, ROC curves, rank tests, false-discovery control, focality and the like.

Rank statistics go over counts per distinct value, not over rows: spike counts and permutation p-values have few distinct
values, so the windows stay small whatever the number of rows.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axonlake.functions import special
from axonlake.session import materialise


def value_counts(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """by..., value, n1 (rows of class 1), n0: null values and null classes are left out; NaN is null."""
    v = F.col(value).cast("double")
    x = df.select(*by, v.alias("_v"), positive.alias("_c")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_c").isNotNull())
    return x.groupBy(*by, F.col("_v").alias("value")).agg(F.count_if("_c").alias("n1"), F.count_if(~F.col("_c")).alias("n0"))


def _sums(vc: DataFrame, by: list[str]) -> DataFrame:
    w = W.partitionBy(*by).orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    x = vc.withColumn("_b1", F.coalesce(F.sum("n1").over(w), F.lit(0))).withColumn("_b0", F.coalesce(F.sum("n0").over(w), F.lit(0)))
    t = F.col("n1") + F.col("n0")
    return x.groupBy(*by).agg(
        F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.sum(F.col("n1") * (2 * F.col("_b0") + F.col("n0"))).alias("_u2"),
        F.sum(F.col("n1") * (2 * (F.col("_b1") + F.col("_b0")) + t + 1)).alias("_r2"), F.sum((t * t * t - t).cast("double")).alias("_ties"), F.count("*").alias("_k"),
    )


def _with_p(df: DataFrame) -> DataFrame:
    """``df`` with the two-sided normal p of its column z. The statistic stays a column of its own: repeated inside the long
    expression it would outgrow what can be compiled."""
    x = df.withColumn("_z", F.explode(F.array("z")))
    return x.withColumn("p", F.least(special.norm_two_sided(F.col("_z")), F.lit(1.0))).drop("_z")


def auc(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """by..., n1, n0, auc, selectivity = 2 auc - 1: P(value of class 1 > value of class 0) + half of the ties; null if a class is empty."""
    s = _sums(value_counts(df, by, value, positive), by)
    a = F.try_divide(F.col("_u2") / 2.0, (F.col("n1") * F.col("n0")).cast("double"))
    return s.select(*by, "n1", "n0", a.alias("auc"), (2 * a - 1).alias("selectivity"))


def roc_curve(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """by..., threshold, tpr, fpr at every distinct value (class 1 if value >= threshold)."""
    vc = value_counts(df, by, value, positive)
    down = W.partitionBy(*by).orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0)
    g = W.partitionBy(*by)
    rate = lambda c: F.try_divide(F.sum(c).over(down).cast("double"), F.sum(c).over(g).cast("double"))
    return vc.select(*by, F.col("value").alias("threshold"), rate("n1").alias("tpr"), rate("n0").alias("fpr"))


def rank_sum(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """Wilcoxon rank-sum (normal approximation, no tie correction): by..., n1, n0, z, p. A constant sample on both sides has p 1."""
    s = _sums(value_counts(df, by, value, positive), by)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    z = F.try_divide(F.col("_r2") / 2.0 - n1 * (n1 + n0 + 1) / 2, F.nullif(F.sqrt(n1 * n0 * (n1 + n0 + 1) / 12), F.lit(0.0)))
    z = F.when((F.col("_k") == 1) & (n1 > 0) & (n0 > 0), F.lit(0.0)).otherwise(z)
    return _with_p(s.select(*by, "n1", "n0", z.alias("z")))


def mann_whitney(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """Mann-Whitney U with tie and continuity correction: by..., n1, n0, u, p (null without spread)."""
    s = _sums(value_counts(df, by, value, positive), by)
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("_r2") / 2.0 - n1 * (n1 + 1) / 2
    var = n1 * n0 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1)))
    z = F.try_divide(F.greatest(F.abs(u - n1 * n0 / 2) - 0.5, F.lit(0.0)), F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)))
    return _with_p(s.select(*by, "n1", "n0", u.alias("u"), z.alias("z"))).drop("z")


def signed_rank(df: DataFrame, by: list[str], difference: str) -> DataFrame:
    """Wilcoxon signed-rank (zeros dropped, tie-corrected normal approximation): by..., n, w (smaller rank sum), p."""
    d = F.round(F.col(difference).cast("double"), 9)
    x = df.select(*by, d.alias("_d")).where(F.col("_d").isNotNull() & ~F.isnan("_d") & (F.col("_d") != 0))
    vc = x.groupBy(*by, F.abs("_d").alias("value")).agg(F.count_if(F.col("_d") > 0).alias("n1"), F.count_if(F.col("_d") < 0).alias("n0"))
    s = _sums(vc, by)
    n = (F.col("n1") + F.col("n0")).cast("double")
    plus = F.col("_r2") / 2.0
    w = F.least(plus, n * (n + 1) / 2 - plus)
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = F.try_divide(w - n * (n + 1) / 4, F.nullif(F.sqrt(var), F.lit(0.0)))
    return _with_p(s.select(*by, n.cast("long").alias("n"), w.alias("w"), z.alias("z"))).drop("z")


def kruskal(df: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction and its chi-square p per ``by``: by..., n_groups, n, h, p."""
    v = F.col(value).cast("double")
    x = df.select(*by, F.col(group).alias("_g"), v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & F.col("_g").isNotNull())
    c = x.groupBy(*by, "_g", "_v").agg(F.count("*").alias("_n"))
    per_value = c.groupBy(*by, "_v").agg(F.sum("_n").alias("_t"))
    w = W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    ranked = per_value.withColumn("_rank", F.coalesce(F.sum("_t").over(w), F.lit(0)) + (F.col("_t") + 1) / 2.0)
    ties = per_value.groupBy(*by).agg(F.sum((F.col("_t") * F.col("_t") * F.col("_t") - F.col("_t")).cast("double")).alias("_ties"), F.sum("_t").alias("n"))
    sums = c.join(ranked, [*by, "_v"]).groupBy(*by, "_g").agg(F.sum(F.col("_n") * F.col("_rank")).alias("_r"), F.sum("_n").alias("_m"))
    h = sums.groupBy(*by).agg(F.count("*").alias("n_groups"), F.sum(F.col("_r") * F.col("_r") / F.col("_m")).alias("_s")).join(ties, by)
    n = F.col("n").cast("double")
    stat = F.try_divide(12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1), F.nullif(1 - F.col("_ties") / (n * n * n - n), F.lit(0.0)))
    p = F.pandas_udf(_chi2, "double")
    return h.withColumn("h", stat).select(*by, "n_groups", "n", "h", p("h", (F.col("n_groups") - 1).cast("double")).alias("p"))


def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.chi2_upper(a, b) if a == a else None for a, b in zip(x, df)], dtype="float64")


def _t(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.t_two_sided(a, b) if a == a and b == b else None for a, b in zip(x, df)], dtype="float64")


def _fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([special.fisher_two_sided(int(p), int(q), int(r), int(s)) for p, q, r, s in zip(a, b, c, d)], dtype="float64")


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of a t statistic (one small kernel call per row of a result table)."""
    return F.pandas_udf(_t, "double")(t, df)


def fisher_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.pandas_udf(_fisher, "double")(a, b, c, d)


def welch(df: DataFrame, by: list[str], value: str, positive: Column) -> DataFrame:
    """Welch's t of class 1 against class 0: by..., n1, n0, mean1, mean0, t, df, p."""
    v = F.col(value)
    one, zero = F.when(positive, v), F.when(~positive, v)
    s = df.groupBy(*by).agg(F.count(one).alias("n1"), F.count(zero).alias("n0"), F.avg(one).alias("mean1"), F.avg(zero).alias("mean0"), F.var_samp(one).alias("_v1"), F.var_samp(zero).alias("_v0"))
    a, b = F.col("_v1") / F.col("n1"), F.col("_v0") / F.col("n0")
    t = F.try_divide(F.col("mean1") - F.col("mean0"), F.nullif(F.sqrt(a + b), F.lit(0.0)))
    dof = F.try_divide((a + b) * (a + b), F.nullif(a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1), F.lit(0.0)))
    ok = (F.col("n1") > 1) & (F.col("n0") > 1)
    s = s.withColumn("t", F.when(ok, t)).withColumn("df", F.when(ok, dof))
    return s.select(*by, "n1", "n0", "mean1", "mean0", "t", "df", t_p(F.col("t"), F.col("df")).alias("p"))


def one_sample_t(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """t of the mean against 0 (a paired test on differences): by..., n, mean, t, p."""
    s = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_s"))
    s = s.withColumn("t", F.try_divide(F.col("mean"), F.nullif(F.col("_s") / F.sqrt("n"), F.lit(0.0))))
    return s.select(*by, "n", "mean", "t", t_p(F.col("t"), (F.col("n") - 1).cast("double")).alias("p"))


def two_proportions(k1: Column, n1: Column, k0: Column, n0: Column) -> tuple[Column, Column]:
    """z and two-sided p of the difference of two proportions with pooled variance."""
    pool = (k1 + k0) / (n1 + n0)
    z = F.try_divide(k1 / n1 - k0 / n0, F.nullif(F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n0)), F.lit(0.0)))
    return z, special.norm_two_sided(z)


def _range(p: Column) -> Column:
    """A monotone whole number of p: 4096 even ranges, and one per halving below the first."""
    return F.when(p >= 1 / 4096, F.floor(p * 4096) + 2000).otherwise(F.floor(F.log2(F.greatest(p, F.lit(1e-300)))) + 2000).cast("long")


def fdr(df: DataFrame, by: list[str], p: str = "p", method: str = "bh", name: str = "p_adj", alpha: float = 0.05, salt: int = 8) -> DataFrame:
    """``df`` with adjusted p-values and ``reject`` (adjusted <= alpha), by Benjamini-Hochberg or (``by``) -Yekutieli per ``by``.

    Null and NaN p-values stay null and are not counted. Works over counts per distinct p; those are cut into ranges, so that
    also a single family with all rows is spread over many tasks: ranks within a range, plus the counts of lower ranges;
    running minima within a range, and the least of the higher ranges. Joined back with a salt, as one p may be most rows.
    Calling this computes ``df`` once and writes it to the shared folder, as several passes read it.
    """
    df = materialise(df, "tests")
    v = F.when(F.col(p).isNotNull() & ~F.isnan(p), F.col(p).cast("double"))
    keys = [f"_f{i}" for i in range(len(by))]
    x = df.withColumn("_p", v).withColumns({k: F.col(c) for k, c in zip(keys, by)})
    vc = x.where(F.col("_p").isNotNull()).groupBy(*keys, "_p").agg(F.count("*").alias("_n")).withColumn("_r", _range(F.col("_p")))
    size = vc.groupBy(*keys, "_r").agg(F.sum("_n").alias("_in"))
    size = size.withColumn("_below", F.coalesce(F.sum("_in").over(W.partitionBy(*keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("_m", F.sum("_in").over(W.partitionBy(*keys)))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    j = vc.alias("v").join(size.alias("s"), same("v", "s", [*keys, "_r"])).select("v.*", "s._below", "s._m")
    up = W.partitionBy(*keys, "_r").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys, "_r").orderBy(F.desc("_p")).rowsBetween(W.unboundedPreceding, 0)
    factor = F.lit(1.0)
    if method == "by":
        m = F.col("_m").cast("double")
        # the harmonic number, by its sum up to 64 and its expansion beyond
        series = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_m"), F.lit(64)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
        factor = F.when(F.col("_m") <= 64, series).otherwise(F.ln(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))
    j = j.withColumn("_q", F.col("_p") * F.col("_m") * factor / (F.col("_below") + F.sum("_n").over(up)))
    j = j.withColumn("_near", F.min("_q").over(down))
    far = j.groupBy(*keys, "_r").agg(F.min("_q").alias("_least"))
    far = far.withColumn("_far", F.min("_least").over(W.partitionBy(*keys).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)))
    adj = j.alias("j").join(far.alias("f"), same("j", "f", [*keys, "_r"])).select(*[F.col(f"j.{k}") for k in keys], F.col("j._p").alias("_p"), F.least("j._near", F.coalesce("f._far", F.lit(1.0)), F.lit(1.0)).alias(name))
    adj = adj.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    y = x.withColumn("_x", F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int"))
    out = y.alias("y").join(adj.alias("a"), [*same("y", "a", keys), F.col("y._p") == F.col("a._p"), F.col("y._x") == F.col("a._x")], "left")
    return out.select(*[F.col(f"y.{c}") for c in df.columns], F.col(f"a.{name}").alias(name)).withColumn("reject", F.coalesce(F.col(name) <= alpha, F.lit(False)))


def focality(df: DataFrame, by: list[str], share: str) -> DataFrame:
    """Sum of squares over the squared sum of area proportions: 1/k for k equal areas, 1 for one; null for a zero sum."""
    s = F.sum(share)
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(share) * F.col(share)), F.nullif(s * s, F.lit(0.0))).alias("focality"))


def gini(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Gini coefficient of non-negative values; null for a zero sum."""
    vc = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # ties take the ranks below + 1 .. below + n: their sum
    x = vc.withColumn("_ir", F.col("_v") * (below * F.col("_n") + F.col("_n") * (F.col("_n") + 1) / 2.0))
    s = x.groupBy(*by).agg(F.sum("_ir").alias("_i"), F.sum(F.col("_v") * F.col("_n")).alias("_s"), F.sum("_n").alias("_m"))
    g = F.try_divide(2 * F.col("_i"), F.nullif(F.col("_m") * F.col("_s"), F.lit(0.0))) - (F.col("_m") + 1) / F.col("_m")
    return s.select(*by, F.col("_m").alias("n"), g.alias("gini"))


def corrected_rate(k: Column, n: Column) -> Column:
    """Log-linear corrected rate: never 0 or 1."""
    return (k + 0.5) / (n + 1)


def harmonic(values: Column) -> Column:
    """Harmonic mean of an aggregate group; null if a value is 0."""
    return F.try_divide(F.count(values).cast("double"), F.sum(F.try_divide(F.lit(1.0), values)))
