"""Peri-event histograms, baselines, z-scores and smoothing, in long form (one row per bin)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axonlake.operators.interval import raster
from axonlake.operators.regular import gaps


def fixed_bins(x: Column, lo: int, hi: int, width: int) -> Column:
    """Bin number of ``x`` in bins of ``width`` from ``lo``; bins are closed on the left, the last on both sides, outside null."""
    n = (hi - lo) // width
    b = F.floor((x - F.lit(lo)) / F.lit(width))
    return F.when((x >= lo) & (x <= hi), F.least(b, F.lit(n - 1))).cast("long")


def with_bins(df: DataFrame, n: int, name: str = "bin") -> DataFrame:
    """Every row once per bin 0..n-1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def peth(points: DataFrame, units: DataFrame, events: DataFrame, keys: list[str], unit: list[str], event: list[str], start: int, stop: int, width: int) -> DataFrame:
    """Counts per unit, event and bin, zeros included: keys, unit, event, bin, n. The window is half open.

    Counting happens before the spine is joined, so the shuffle carries occupied bins; the spine is needed only where single
    trials with their zeros are the result.
    """
    rel = raster(points, events, keys, start, stop, "left")
    by = [*keys, *unit, *event, "bin"]
    hits = rel.withColumn("bin", F.floor((F.col("t_rel_us") - F.lit(start)) / F.lit(width))).groupBy(*by).agg(F.count("*").alias("n"))
    spine = with_bins(units.select(*keys, *unit).join(events.select(*keys, *event), keys), (stop - start) // width)
    return spine.join(hits, by, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def mean_peth(points: DataFrame, units: DataFrame, events: DataFrame, keys: list[str], unit: list[str], cond: list[str], start: int, stop: int, width: int) -> DataFrame:
    """Mean rate per unit, condition and bin over the condition's events, with n_events, total, rate (per second), sem.

    Moments are summed over occupied (event, bin) cells only; empty cells enter through the number of events, so single
    trials are never spread out. ``sem`` is the population deviation over the root of the number of events.
    """
    rel = raster(points, events, keys, start, stop, "left")
    cell = rel.withColumn("bin", F.floor((F.col("t_rel_us") - F.lit(start)) / F.lit(width))).groupBy(*keys, *unit, *cond, "event_id", "bin").agg(F.count("*").alias("c"))
    sums = cell.groupBy(*keys, *unit, *cond, "bin").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    n = events.groupBy(*keys, *cond).agg(F.count("*").alias("n_events"))
    spine = with_bins(units.select(*keys, *unit).join(n, keys), (stop - start) // width)
    x = spine.join(sums, [*keys, *unit, *cond, "bin"], "left").withColumn("s", F.coalesce("s", F.lit(0))).withColumn("q", F.coalesce("q", F.lit(0)))
    m = F.col("s") / F.col("n_events")
    var = F.greatest(F.col("q") / F.col("n_events") - m * m, F.lit(0.0))
    sec = width / 1e6
    return x.select(*keys, *unit, *cond, "bin", "n_events", F.col("s").alias("total"), (m / sec).alias("rate"), (F.sqrt(var) / F.sqrt("n_events") / sec).alias("sem"))


def subtract_baseline(df: DataFrame, by: list[str], value: str, bins_before: int, name: str = "value", bin_col: str = "bin") -> DataFrame:
    """``value`` minus its mean over the bins before ``bins_before`` of the same ``by``."""
    base = F.avg(F.when(F.col(bin_col) < bins_before, F.col(value))).over(W.partitionBy(*by))
    return df.withColumn(name, F.col(value) - base)


def zscore(df: DataFrame, by: list[str], value: str, where: Column | None = None, name: str = "z") -> DataFrame:
    """(value - mean) / population deviation per ``by``, over the rows of ``where`` if given; null for a constant."""
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    x = F.col(value) if where is None else F.when(where, F.col(value))
    return df.withColumn(name, F.try_divide(F.col(value) - F.avg(x).over(w), F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))))


def weights_gauss(sigma: float, radius: int, causal: bool) -> list[float]:
    """Gaussian weights at lags 0..radius (causal) or -radius..radius, summing to one."""
    lags = range(0, radius + 1) if causal else range(-radius, radius + 1)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in lags]
    return [x / sum(w) for x in w]


def fir(df: DataFrame, by: list[str], order: str, value: str, weights: list[float], first_lag: int, name: str = "smooth", edge: str = "zero") -> DataFrame:
    """Weighted sum of neighbours: weight i belongs to the row ``first_lag + i`` rows before. Beyond the ends: zero or nearest."""
    w = W.partitionBy(*by).orderBy(order)
    ends = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    out = F.lit(0.0)
    for i, x in enumerate(weights):
        k = first_lag + i
        outer = F.lit(0.0) if edge == "zero" else (F.first(value).over(ends) if k > 0 else F.last(value).over(ends)).cast("double")
        cell = F.lag(F.col(value).cast("double"), k).over(w) if k >= 0 else F.lead(F.col(value).cast("double"), -k).over(w)
        out = out + F.lit(x) * F.coalesce(cell, outer)
    return df.withColumn(name, out)


def savgol_weights(window: int, order: int) -> list[float]:
    """Savitzky-Golay smoothing weights of an odd window: the least-squares polynomial's value at the centre."""
    import numpy as np

    k = np.arange(window) - window // 2
    return np.linalg.pinv(np.vander(k, order + 1, increasing=True))[0].tolist()


def moving_average(df: DataFrame, by: list[str], order: str, value: str, half: int, name: str = "smooth") -> DataFrame:
    """Centred mean of 2 half + 1 rows, of fewer at the ends."""
    return df.withColumn(name, F.avg(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-half, half)))


def boxcar(df: DataFrame, by: list[str], order: str, value: str, k: int, name: str = "smooth") -> DataFrame:
    """Sum of the row and the k - 1 before it."""
    return df.withColumn(name, F.sum(value).over(W.partitionBy(*by).orderBy(order).rowsBetween(-(k - 1), 0)))


def median_filter(df: DataFrame, by: list[str], order: str, value: str, half: int, name: str = "smooth") -> DataFrame:
    return df.withColumn(name, F.percentile(value, F.lit(0.5)).over(W.partitionBy(*by).orderBy(order).rowsBetween(-half, half)))


def bin_means(samples: DataFrame, keys: list[str], t: str, value: str, lo: float, width: float, n: int) -> DataFrame:
    """Mean of an analog series per bin of width ``width`` from ``lo``; an empty bin is 0: keys, bin, mean, n."""
    fine = F.col(value).isNotNull() & ~F.isnan(value)
    x = samples.where(fine).withColumn("bin", F.floor((F.col(t) - F.lit(lo)) / F.lit(width)).cast("long")).where(F.col("bin").between(0, n - 1))
    m = x.groupBy(*keys, "bin").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    spine = with_bins(samples.select(*keys).distinct(), n)
    return spine.join(m, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def bin_means_whole(samples: DataFrame, keys: list[str], t: str, value: str, width: float) -> DataFrame:
    """Mean of an analog series per bin floor(t / width), from the bin of a key's first time to that of its last: keys, bin, mean, n.

    An empty bin is 0, and so is one whose values are all null or NaN. A null or NaN time is no data; a null key is a series
    of its own. Empty bins are the gaps between occupied ones, made in bounded pieces.
    """
    there = F.col(t).isNotNull() & ~F.isnan(t)
    fine = F.when(F.col(value).isNotNull() & ~F.isnan(value), F.col(value))
    x = samples.where(there).withColumn("bin", F.floor(F.col(t) / F.lit(width)).cast("long"))
    # sums in decimals of eight places: their order changes no digit
    total = F.sum(fine.cast("decimal(28,8)")).cast("double")
    m = x.groupBy(*keys, "bin").agg(F.coalesce(F.try_divide(total, F.count(fine)), F.lit(0.0)).alias("mean"), F.count(fine).alias("n"))
    empty = gaps(m.select(*keys, "bin"), keys, "bin").withColumns({"mean": F.lit(0.0), "n": F.lit(0).cast("long")})
    return m.unionByName(empty)


def first_crossing(df: DataFrame, by: list[str], t: str, value: str, frac: float, name: str = "latency") -> DataFrame:
    """First time at which the value reaches ``frac`` of the group's peak (by absolute size, keeping its sign)."""
    peak = F.max_by(value, F.abs(value)).over(W.partitionBy(*by))
    x = df.withColumn("_p", peak).where((F.col("_p") != 0) & (F.col(value) * F.signum("_p") >= frac * F.abs("_p")))
    return x.groupBy(*by).agg(F.min(t).alias(name))


def onset(df: DataFrame, by: list[str], t: str, value: str, baseline: Column, sds: float = 3.0, name: str = "onset", eps: float = 1e-9) -> DataFrame:
    """First time at which the value and the next one exceed the baseline's mean by ``sds`` population deviations (and ``eps``)."""
    g = W.partitionBy(*by)
    level = F.avg(F.when(baseline, F.col(value))).over(g) + F.lit(sds) * F.stddev_pop(F.when(baseline, F.col(value))).over(g) + F.lit(eps)
    x = df.withColumn("_l", level).withColumn("_n", F.lead(value).over(g.orderBy(t)))
    return x.where(~baseline & (F.col(value) > F.col("_l")) & (F.col("_n") > F.col("_l"))).groupBy(*by).agg(F.min(t).alias(name))
