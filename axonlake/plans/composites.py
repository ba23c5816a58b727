"""Pipelines that compose several operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.operators import corr, fit, hist, quality, resample as rs, stats, relational as rel
from axonlake.plans import correlation as co, models, spikes as sk
from axonlake.plans.registry import Book, Data
from axonlake.plans.statistics import _CNT, response_counts

book = Book()
UNIT = ["session_id", "unit_id"]


@book("cmp_passive_psth", sk._PETH + """, p AS (SELECT session_id, unit_id, bin, avg(n) / 0.5 AS rate FROM cell WHERE ctx = 'passive' GROUP BY 1, 2, 3), z AS (SELECT *, avg(rate) OVER w AS m, stddev_pop(rate) OVER w AS s FROM p WINDOW w AS (PARTITION BY session_id, unit_id)),
y AS (SELECT session_id, unit_id, bin, (rate - m) / CASE WHEN s < 1e-9 THEN NULL ELSE s END AS z FROM z), r AS (SELECT session_id, unit_id, round(avg(z) FILTER (bin BETWEEN 2 AND 3), 6) AS response FROM y GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY response DESC NULLS LAST, unit_id) AS place FROM r) SELECT y.session_id, y.unit_id, k.place, y.bin, round(y.z, 4) + 0.0 AS z FROM y JOIN k ON k.session_id = y.session_id AND k.unit_id = y.unit_id""", "us sp tr")
def _(d: Data) -> DataFrame:
    """The z-scored passive histogram of every unit, with its place in the session's matrix by early response."""
    t = d.trial_rows().where("ctx = 'passive'").select("session_id", "event_id", "at_us")
    p = hist.mean_peth(d.spikes(), d.unit_rows(), t, ["session_id"], ["unit_id"], [], -sk.S, 3 * sk.S, sk.S // 2)
    w = W.partitionBy(*UNIT)
    sd = F.stddev_pop("rate").over(w)
    z = p.withColumn("z", (F.col("rate") - F.avg("rate").over(w)) / F.when(sd >= 1e-9, sd))
    z = z.withColumn("response", F.round(F.avg(F.when(F.col("bin").between(2, 3), F.col("z"))).over(w), 6))
    # one row per unit is ranked; its bins follow by the equality of response and unit
    place = F.dense_rank().over(W.partitionBy("session_id").orderBy(F.desc_nulls_last("response"), "unit_id"))
    return z.withColumn("place", place).select(*UNIT, "place", "bin", (F.round("z", 4) + 0.0).alias("z"))


@book("cmp_bin_variants", sk._RATES + "SELECT session_id, unit_id, bin // 2 AS step, round(s, 5) AS smooth FROM (SELECT *, sum(rate) OVER (PARTITION BY session_id, unit_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM p) WHERE bin % 2 = 1", "us sp tr")
def _(d: Data) -> DataFrame:
    """Strided bins: windows of three bins, every second one, trimmed at the ends."""
    s = F.sum("rate").over(W.partitionBy(*UNIT).orderBy("bin").rowsBetween(-1, 1))
    return sk._rate_rows(d).withColumn("s", s).where("bin % 2 = 1").select(*UNIT, F.floor(F.col("bin") / 2).alias("step"), F.round("s", 5).alias("smooth"))


@book("cmp_acg", f"WITH {co._CCG} SELECT session_id, unit_a AS unit_id, lag_bin, n FROM ccg WHERE unit_a = unit_b", "sp")
def _(d: Data) -> DataFrame:
    """Autocorrelograms: lag pairs of one unit only."""
    return corr.autocorrelogram(d.spikes(), UNIT, 100_000, 10_000)


_AREA = "ar AS (SELECT DISTINCT session_id, unit_id, ccf_parent_acronym AS area FROM units)"


@book("cmp_xcorr_area", co._CCH_MS + co._HIT_MS + ", pr2 AS (SELECT DISTINCT session_id, unit_a, unit_b FROM cch), " + _AREA + " SELECT area, count(*) AS n_pairs, round(avg(CAST(hit.kind IS NOT NULL AS INT)), 6) AS rate FROM pr2 JOIN ar ON ar.session_id = pr2.session_id AND ar.unit_id = pr2.unit_a LEFT JOIN hit ON hit.session_id = pr2.session_id AND hit.unit_a = pr2.unit_a AND hit.unit_b = pr2.unit_b GROUP BY 1", "sp")
def _(d: Data) -> DataFrame:
    """Part of the pairs with a significant interaction, per area of the source unit."""
    p = co.ccg_ms(d, "found").withColumn("sig", F.col("lag_bin").isNotNull().cast("int")).groupBy("session_id", "unit_a").agg(F.count("*").alias("n"), F.sum("sig").alias("sig"))
    u = d.unit_rows("ccf_parent_acronym").select("session_id", F.col("unit_id").alias("unit_a"), F.col("ccf_parent_acronym").alias("area"))
    return p.join(u, ["session_id", "unit_a"]).groupBy("area").agg(F.sum("n").alias("n_pairs"), F.round(F.sum("sig") / F.sum("n"), 6).alias("rate"))


_EDGES = ", ed AS (SELECT h.session_id, least(unit_a, unit_b) AS source_id, greatest(unit_a, unit_b) AS target_id, CASE WHEN unit_a < unit_b THEN lag_bin ELSE -lag_bin END AS lag, kind FROM hit h), " + _AREA + ", e AS (SELECT ed.*, x.area AS source_area, y.area AS target_area FROM ed JOIN ar x ON x.session_id = ed.session_id AND x.unit_id = source_id JOIN ar y ON y.session_id = ed.session_id AND y.unit_id = target_id), fl AS (SELECT session_id, CASE WHEN lag < 0 THEN target_id ELSE source_id END AS source_id, CASE WHEN lag < 0 THEN source_id ELSE target_id END AS target_id, CASE WHEN lag < 0 THEN target_area ELSE source_area END AS source_area, CASE WHEN lag < 0 THEN source_area ELSE target_area END AS target_area, abs(lag) AS lag, kind FROM e) "


def edges(d: Data) -> DataFrame:
    """The interactions found between pairs, from the unit that fires first to the one that follows."""
    h = co.hits(d)
    a, b = F.least("unit_a", "unit_b"), F.greatest("unit_a", "unit_b")
    e = h.select("session_id", a.alias("source_id"), b.alias("target_id"), F.when(F.col("unit_a") < F.col("unit_b"), F.col("lag_bin")).otherwise(-F.col("lag_bin")).alias("lag"), "kind")
    u = d.unit_rows("ccf_parent_acronym")
    side = lambda s: u.select("session_id", F.col("unit_id").alias(f"{s}_id"), F.col("ccf_parent_acronym").alias(f"{s}_area"))
    e = e.join(side("source"), ["session_id", "source_id"]).join(side("target"), ["session_id", "target_id"])
    return rel.flip_negative(e, "lag", [("source_id", "target_id"), ("source_area", "target_area")])


@book("flip_edges", co._CCH_MS + co._HIT_MS + _EDGES + "SELECT session_id, source_id, target_id, source_area, target_area, lag, kind FROM fl", "sp")
def _(d: Data) -> DataFrame:
    return edges(d).select("session_id", "source_id", "target_id", "source_area", "target_area", "lag", "kind")


@book("cmp_interaction_counts", co._CCH_MS + co._HIT_MS + _EDGES + "SELECT source_area, target_area, lag, count(*) AS n, count(*) FILTER (kind = 'excitatory') AS n_excitatory, count(*) FILTER (kind = 'inhibitory') AS n_inhibitory FROM fl GROUP BY 1, 2, 3", "sp")
def _(d: Data) -> DataFrame:
    """Interactions found per pair of areas and lag, by kind."""
    kind = lambda k: F.count_if(F.col("kind") == k).alias(f"n_{k}")
    return edges(d).groupBy("source_area", "target_area", "lag").agg(F.count("*").alias("n"), kind("excitatory"), kind("inhibitory"))


@book("cmp_ccg_by_sign", co._SER.format(a=-10, y="zy") + ", q AS (SELECT session_id, unit_id, lag, round(r, 5) + 0.0 AS r FROM xl WHERE r IS NOT NULL), pk AS (SELECT session_id, unit_id, CASE WHEN arg_max(r, (abs(r), -lag)) >= 0 THEN 'positive' ELSE 'negative' END AS kind FROM q GROUP BY 1, 2) SELECT kind, CAST(lag AS INT) AS lag, count(*) AS n, CAST(CAST(sum(CAST(round(r * 100000) AS BIGINT)) AS BIGINT) AS DOUBLE) / (count(*) * 100000) AS mean FROM q JOIN pk USING (session_id, unit_id) GROUP BY 1, 2", "us sp tr")
def _(d: Data) -> DataFrame:
    """Mean lag correlation of the units whose peak is positive, and of those whose peak is negative; summed in whole units of the fifth decimal."""
    q = co.trial_lags(d).withColumn("r", F.round("r", 5) + 0.0).where("r is not null")
    pk = q.groupBy(*UNIT).agg(F.max_by("r", F.struct(F.abs("r"), -F.col("lag"))).alias("peak"))
    kind = F.when(F.col("peak") >= 0, "positive").otherwise("negative")
    return q.join(pk, UNIT).groupBy(kind.alias("kind"), "lag").agg(F.count("*").alias("n"), (F.sum(F.round(F.col("r") * 100000).cast("long")).cast("double") / (F.count("*") * 100000)).alias("mean"))


@book("cmp_lookup_cell", "SELECT area_acronym_custom AS area, analysis_type, round(100.0 * count(*) FILTER (significant AND selectivity > 0) / count(*), 6) AS positive, round(100.0 * count(*) FILTER (significant AND selectivity < 0) / count(*), 6) AS negative, round(100.0 * count(*) FILTER (NOT significant OR significant IS NULL OR selectivity IS NULL OR selectivity = 0) / count(*), 6) AS none FROM roc GROUP BY 1, 2", "roc")
def _(d: Data) -> DataFrame:
    """Percent of positive, negative and not selective results per area and analysis; the three add up to 100."""
    sig = F.coalesce("significant", F.lit(False))
    pos, neg = sig & (F.col("selectivity") > 0), sig & (F.col("selectivity") < 0)
    pos, neg = F.coalesce(pos, F.lit(False)), F.coalesce(neg, F.lit(False))
    pct = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 6)
    return d.roc().groupBy(F.col("area_acronym_custom").alias("area"), "analysis_type").agg(pct(pos).alias("positive"), pct(neg).alias("negative"), pct(~pos & ~neg).alias("none"))


_POP = _CNT + ", pr AS (SELECT session_id, event_id, avg(post - pre) AS y FROM c GROUP BY 1, 2), s AS (SELECT session_id, event_id, y, row_number() OVER w - 1 AS k, coalesce(sum(y) OVER (PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, count(*) OVER g AS n, sum(y) OVER g AS t, sum(y * y) OVER g AS q FROM pr WINDOW w AS (PARTITION BY session_id ORDER BY event_id), g AS (PARTITION BY session_id)), r AS (SELECT session_id, k, CASE WHEN q - t * t / n > 1e-9 THEN greatest((s * s / k + (t - s) * (t - s) / (n - k) - t * t / n) / (q - t * t / n), 0) ELSE 0 END AS r2 FROM s WHERE k > 0) SELECT session_id, round(max(r2), 5) + 0.0 AS best_r2, CAST(arg_max(k, (round(r2, 7), -k)) AS BIGINT) AS split FROM r GROUP BY 1"


@book("cmp_pop_inflection", _POP, "us sp tr")
def _(d: Data) -> DataFrame:
    """Where a step explains most of the population's mean response over trials, per session."""
    pop = response_counts(d).groupBy("session_id", "event_id").agg(F.avg(F.col("post") - F.col("pre")).alias("y"))
    r = rs.step_r2(pop, ["session_id"], "event_id", "y")
    return r.groupBy("session_id").agg((F.round(F.max("r2"), 5) + 0.0).alias("best_r2"), F.max_by("split", F.struct(F.round("r2", 7), -F.col("split"))).cast("long").alias("split"))


@book("cmp_shift_run")
def _(d: Data) -> DataFrame:
    """Shift tests of every unit, then per area: Welch's t and Mann-Whitney of the correlations between reward groups, with
    false-discovery control, and a bootstrap interval of the mean over mice."""
    s = rs.shift_test(response_counts(d), UNIT, "event_id", "post", "lick_flag").where("r is not null")
    x = s.join(d.unit_rows("mouse_id", "ccf_parent_acronym", "reward_group"), UNIT).withColumnRenamed("ccf_parent_acronym", "area").where("area is not null")
    one = F.col("reward_group") == 1
    t = stats.welch(x, ["area"], "r", one).select("area", "n1", "n0", "t", F.col("p").alias("p_welch"))
    u = stats.mann_whitney(x, ["area"], "r", one).select("area", F.col("p").alias("p_mwu"))
    m = x.groupBy("area", F.col("mouse_id").alias("mouse")).agg(F.avg("r").alias("r"))
    ci = rs.bootstrap_mean(m, ["area"], "mouse", "r", 2000)
    return stats.fdr(t.join(u, "area").join(ci, "area"), [], "p_mwu")


@book("cmp_noise_units")
def _(d: Data) -> DataFrame:
    """Kept and noise units per curation label, and how often each flag was raised."""
    q = quality.score_units(models.unit_table(d), UNIT).join(d.unit_rows("bc_label"), UNIT)
    flags = [c for c in q.columns if c.startswith("flag_")]
    return q.groupBy(F.lower(F.trim("bc_label")).alias("label"), "is_noise").agg(F.count("*").alias("n"), *[F.count_if(f).alias(f"n_{f}") for f in flags])


@book("cmp_cluster_pipeline")
def _(d: Data) -> DataFrame:
    """Rate filter, one response vector per unit, principal components, k-means, and the clusters' make-up by area."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    keep = sk.mean_rate(d).where("rate > 0").select(*UNIT)
    p = sk._mean(d, ["trial_type"]).join(keep, UNIT, "left_semi")
    z = hist.zscore(p, UNIT, "rate")
    n = 24  # three trial types of eight bins; units that lack a type are left out
    v = z.groupBy(*UNIT).agg(F.transform(F.array_sort(F.collect_list(F.struct("trial_type", "bin", F.coalesce("z", F.lit(0.0)).alias("z")))), lambda x: x["z"]).alias("a")).where(F.size("a") == n)
    v = v.withColumn("raw", array_to_vector("a"))
    pcs = PCA(k=5, inputCol="raw", outputCol="features").fit(v).transform(v)
    rows, _cost = fit.kmeans(pcs, 6)
    return rows.join(d.unit_rows("ccf_parent_acronym"), UNIT).groupBy("cluster", F.col("ccf_parent_acronym").alias("area")).agg(F.count("*").alias("n"))


QUERIES, ORACLE = book.queries, book.oracle
