"""Permutation, bootstrap and shift tests with repeatable draws.

Draws depend only on (seed, repetition, key), by an arithmetic congruential order that any engine can repeat, so results
do not depend on partitions. Labels are permuted at the smallest entity (mouse, unit), joined to pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axonlake.functions import special

#: A prime modulus and multipliers of the draw order.
P, A, B, C = 1000003, 7919, 104729, 12345


def draw(key: Column, rep: Column, seed: int = 1) -> Column:
    """A whole number 0..P-1 that orders keys in each repetition."""
    x = F.pmod(key.cast("long") * A + rep.cast("long") * B + F.lit(seed * C), F.lit(P))
    return F.pmod(x * x + x * A + rep, F.lit(P))


def draw_sql(key: str, rep: str, seed: int = 1) -> str:
    x = f"(({key} * {A} + {rep} * {B} + {seed * C}) % {P})"
    return f"(({x} * {x} + {x} * {A} + {rep}) % {P})"


def repetitions(df: DataFrame, n: int) -> DataFrame:
    """Every row once per repetition 1..n."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n))))


def permuted_labels(entities: DataFrame, by: list[str], key: str, label: str, n: int, seed: int = 1) -> DataFrame:
    """by, key, rep, label: the labels of each ``by`` dealt out anew in every repetition; rep 0 holds the true ones."""
    place = F.row_number().over(W.partitionBy(*by, "rep").orderBy(draw(F.col(key), F.col("rep"), seed), key)) if by else F.row_number().over(W.partitionBy("rep").orderBy(draw(F.col(key), F.col("rep"), seed), key))
    own = W.partitionBy(*by).orderBy(key) if by else W.orderBy(key)
    ranked = entities.select(*by, key, label).withColumn("_i", F.row_number().over(own))
    dealt = repetitions(ranked.select(*by, key), n).withColumn("_i", place)
    again = dealt.join(ranked.select(*by, "_i", label), [*by, "_i"]).drop("_i")
    return entities.select(*by, key, F.lit(0).alias("rep"), label).unionByName(again.select(*by, key, "rep", label))


def permutation_p(stat: DataFrame, by: list[str], value: str, alternative: str = "two-sided", plus_one: bool = True, slack: float = 1e-12) -> DataFrame:
    """by, observed, n_rep, p from rows (by, rep, value) with the true statistic at rep 0. Null statistics count in neither.

    ``slack``: how far below the true statistic still counts as equal to it."""
    w = W.partitionBy(*by)
    x = stat.where(F.col(value).isNotNull()).withColumn("_o", F.max(F.when(F.col("rep") == 0, F.col(value))).over(w)).where("rep > 0")
    far = {"two-sided": F.abs(value) >= F.abs("_o") - slack, "greater": F.col(value) >= F.col("_o") - slack, "less": F.col(value) <= F.col("_o") + slack}[alternative]
    k, n = F.count_if(far), F.count("*")
    p = (k + 1) / (n + 1) if plus_one else k / n
    return x.groupBy(*by).agg(F.max("_o").alias("observed"), n.alias("n_rep"), p.alias("p")).where("observed is not null")


def bootstrap_draws(entities: DataFrame, by: list[str], key: str, n: int, seed: int = 1) -> DataFrame:
    """by, key, rep, times: how often each entity of a ``by`` is drawn with replacement in each repetition (only times > 0)."""
    g = W.partitionBy(*by)
    ranked = entities.select(*by, key).distinct().withColumn("_i", F.row_number().over(g.orderBy(key)) - 1).withColumn("_n", F.count("*").over(g))
    # in each repetition entity number j draws one entity
    d = repetitions(ranked, n).withColumn("_to", F.floor(draw(F.col("_i") + 1, F.col("rep"), seed) * F.col("_n") / P))
    times = d.groupBy(*by, "rep", F.col("_to").alias("_i")).agg(F.count("*").alias("times"))
    # the hints here and below keep draws, planned as if there were one per entity, from being broadcast
    return times.hint("merge").join(ranked.select(*by, key, "_i"), [*by, "_i"]).select(*by, key, "rep", "times")


def bootstrap_mean(df: DataFrame, by: list[str], key: str, value: str, n: int, seed: int = 1, level: float = 0.95) -> DataFrame:
    """by, mean, low, high: percentile interval of the mean over resampled entities (multiplicity kept)."""
    d = bootstrap_draws(df, by, key, n, seed).hint("merge").join(df.select(*by, key, value), [*by, key])
    m = d.groupBy(*by, "rep").agg((F.sum(F.col(value) * F.col("times")) / F.sum(F.when(F.col(value).isNotNull(), F.col("times")))).alias("m"))
    a = (1 - level) / 2
    ci = m.groupBy(*by).agg(F.percentile("m", F.array(F.lit(a), F.lit(1 - a))).alias("_c"))
    return df.groupBy(*by).agg(F.avg(value).alias("mean")).join(ci, by).select(*by, "mean", F.element_at("_c", 1).alias("low"), F.element_at("_c", 2).alias("high"))


def shift_test(series: DataFrame, by: list[str], index: str, x: str, y: str, n: int = 39, **kw) -> DataFrame:
    """The linear-shift test of ``series.shift_test``."""
    from axonlake.operators import series as kernels

    return kernels.shift_test(series, by, index, x, y, n, **kw)


def step_r2(series: DataFrame, by: list[str], index: str, value: str) -> DataFrame:
    """by, split, r2: R squared of a step at every possible split (rows before it against the rest), from running sums."""
    w = W.partitionBy(*by).orderBy(index)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    g = W.partitionBy(*by)
    v = F.col(value).cast("double")
    s = series.select(*by, index, v.alias("_v")).withColumn("_k", F.row_number().over(w) - 1).withColumn("_s", F.coalesce(F.sum("_v").over(past), F.lit(0.0)))
    s = s.withColumn("_n", F.count("*").over(g)).withColumn("_t", F.sum("_v").over(g)).withColumn("_q", F.sum(F.col("_v") * F.col("_v")).over(g)).where("_k > 0")
    n, k = F.col("_n"), F.col("_k")
    between = F.col("_s") * F.col("_s") / k + (F.col("_t") - F.col("_s")) * (F.col("_t") - F.col("_s")) / (n - k) - F.col("_t") * F.col("_t") / n
    total = F.col("_q") - F.col("_t") * F.col("_t") / n
    return s.select(*by, F.col("_k").alias("split"), F.when(total > 1e-9, F.greatest(between / total, F.lit(0.0))).otherwise(0.0).alias("r2"))


def replace_artifact(points: DataFrame, events: DataFrame, keys: list[str], unit: str, lo: int, hi: int, base_lo: int, seed: int = 7) -> DataFrame:
    """Spikes with those in [lo, hi) after each event replaced by a Poisson draw at the rate of [base_lo, lo) before it, evenly placed.

    The draw is repeatable: with a uniform hash of (seed, unit, event, piece) per piece of at most 16 expected spikes, by the
    inverse of the distribution; the pieces' draws add up, so any rate is drawn in full.
    """
    from axonlake.operators.interval import range_join

    inside = range_join(points, events, keys, lo, hi).select(*points.columns).distinct()
    kept = points.join(inside, points.columns, "left_anti")
    base = range_join(points, events, keys, base_lo, lo).groupBy(*keys, unit, "event_id").agg(F.count("*").alias("_c"))
    lam = F.col("_c") * ((hi - lo) / (lo - base_lo))
    base = base.withColumn("_pieces", F.greatest(F.ceil(lam / 16), F.lit(1)).cast("int")).withColumn("_l", lam / F.col("_pieces")).withColumn("_piece", F.explode(F.sequence(F.lit(1), F.col("_pieces"))))
    u = F.pmod(F.xxhash64(*keys, unit, "event_id", "_piece", F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)
    step = lambda a, i: F.struct((a["p"] * a["l"] / i).alias("p"), (a["c"] + a["p"]).alias("c"), a["l"].alias("l"), (a["k"] + F.when(a["u"] > a["c"] + a["p"], 1).otherwise(0)).alias("k"), a["u"].alias("u"))
    start = F.struct(F.exp(-F.col("_l")).alias("p"), F.lit(0.0).alias("c"), F.col("_l").alias("l"), F.lit(0).alias("k"), u.alias("u"))
    # a uniform of 24 bits never asks for more than 64 spikes of a mean of 16
    drawn = base.withColumn("_k", F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step, lambda a: a["k"]))
    drawn = drawn.groupBy(*keys, unit, "event_id").agg(F.sum("_k").cast("int").alias("_k")).where("_k > 0")
    new = drawn.join(events.select(*keys, "event_id", "at_us"), [*keys, "event_id"]).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    t = (F.col("at_us") + F.lit(lo) + F.lit(hi - lo) * F.col("_i") / (F.col("_k") + 1)).cast("long")
    return kept.unionByName(new.select(*keys, unit, t.alias("t_us")).select(*points.columns))
