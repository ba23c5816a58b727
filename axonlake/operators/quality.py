"""Unit quality: a registry of metrics, each a column of a per-unit table with a rule for its flag."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axonlake.functions.labels import waveform_stats


@dataclass(frozen=True)
class Metric:
    """``score`` of a row of the per-unit table; the unit is suspect if the score is below ``low`` or above ``high``."""

    name: str
    score: Column
    low: float | None = None
    high: float | None = None


def unit_features(units: DataFrame, spikes: DataFrame, keys: list[str], refractory: int = 2000) -> DataFrame:
    """Per unit: spike count, span, inter-spike statistics (violations, CV, long share, skewness), burst index, waveform statistics."""
    w = W.partitionBy(*keys).orderBy("t_us")
    i = spikes.withColumn("isi", (F.col("t_us") - F.lag("t_us").over(w)).cast("double"))
    isi = F.col("isi")
    m, s = F.avg(isi), F.stddev_pop(isi)
    third = F.avg(isi * isi * isi) - 3 * m * F.avg(isi * isi) + 2 * m * m * m
    stats = i.groupBy(*keys).agg(
        F.count("*").alias("n_spikes"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"),
        F.avg((isi < refractory).cast("int")).alias("isi_violation"), F.try_divide(s, F.nullif(m, F.lit(0.0))).alias("isi_cv"), F.avg((isi > 1_000_000).cast("int")).alias("isi_long"),
        F.try_divide(third, F.nullif(F.pow(s, 3), F.lit(0.0))).alias("isi_skew"), F.avg((isi < 10_000).cast("int")).alias("burst_index"),
    )
    wf = waveform_stats(F.col("waveform_mean"))
    u = units.withColumns({f"wf_{k}": wf[k] for k in ("amplitude", "width", "crossings")})
    return u.join(stats, keys, "left").withColumn("n_spikes", F.coalesce("n_spikes", F.lit(0)))


def default_metrics() -> list[Metric]:
    c = F.col
    return [
        Metric("rate", F.try_divide(c("n_spikes").cast("double"), F.nullif((c("last_us") - c("first_us")) / 1e6, F.lit(0.0))), 0.1, 100.0),
        Metric("isi_violation", c("isi_violation"), None, 0.05), Metric("isi_cv", c("isi_cv"), 0.2, 3.0), Metric("isi_long", c("isi_long"), None, 0.9), Metric("burst", c("burst_index"), None, 0.3),
        Metric("amplitude", c("wf_amplitude"), 1.0, None), Metric("crossings", c("wf_crossings").cast("double"), None, 6.0), Metric("presence", c("presenceRatio"), 0.7, None),
    ]


def score_units(features: DataFrame, keys: list[str], metrics: list[Metric] | None = None, at_least: int = 2) -> DataFrame:
    """keys, score_*, flag_*, n_flags, is_noise. A metric without a score raises no flag."""
    metrics = metrics or default_metrics()
    x = features.select(*keys, *[m.score.alias(f"score_{m.name}") for m in metrics])
    flags = {}
    for m in metrics:
        s = F.col(f"score_{m.name}")
        bad = F.lit(False)
        if m.low is not None:
            bad = bad | (s < m.low)
        if m.high is not None:
            bad = bad | (s > m.high)
        flags[f"flag_{m.name}"] = F.coalesce(bad, F.lit(False))
    x = x.withColumns(flags)
    n = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return x.withColumn("n_flags", n).withColumn("is_noise", F.col("n_flags") >= at_least)
