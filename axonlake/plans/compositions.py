"""Compositions over the result and trial tables: masked sums, rankings, labels per trial, dimension tables, joins with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake import sources
from axonlake.operators import hist, resample as rs
from axonlake.plans import correlation as co, models, spikes as sk
from axonlake.plans.registry import Book, Data
from axonlake.plans.statistics import shifts
from axonlake.session import scratch_dir

book = Book()
UNIT = ["session_id", "unit_id"]
AREA = "area_acronym_custom"


@book("win_cond_sum", f"SELECT result_id, CAST(sum(CASE WHEN analysis_type = 'whisker_active' AND significant THEN 1 ELSE 0 END) OVER (PARTITION BY mouse_id, {AREA}) AS BIGINT) AS n_whisker FROM roc", "roc")
def _(d: Data) -> DataFrame:
    """On every row its group's number of significant whisker results: counted per group first, so a hot group is one joined row."""
    r = d.roc()
    hit = F.count_if((F.col("analysis_type") == "whisker_active") & F.coalesce("significant", F.lit(False))).alias("n_whisker")
    g = r.groupBy(F.col("mouse_id").alias("_m"), F.col(AREA).alias("_a")).agg(hit)
    on = F.col("mouse_id").eqNullSafe(F.col("_m")) & F.col(AREA).eqNullSafe(F.col("_a"))
    return r.join(g, on).select("result_id", "n_whisker")


_RATE = "WITH n AS (SELECT DISTINCT result_id, area, CASE WHEN isnan(mean_firing_rate) THEN NULL ELSE mean_firing_rate END AS x FROM neuron_results) "


@book("agg_quantile", _RATE + "SELECT area, round(quantile_cont(x, 0.05), 5) AS q05, round(quantile_cont(x, 0.5), 5) AS q50, round(quantile_cont(x, 0.95), 5) AS q95 FROM n GROUP BY 1")
def _(d: Data) -> DataFrame:
    """Percentiles with linear interpolation, from counts per value."""
    n = d.neuron_results.select("result_id", "area", F.when(~F.isnan("mean_firing_rate"), F.col("mean_firing_rate")).alias("x")).distinct()
    c = n.groupBy("area", "x").agg(F.count("*").alias("w"))
    q = F.percentile("x", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)), F.col("w"))
    return c.groupBy("area").agg(q.alias("q")).select("area", *[F.round(F.col("q")[i], 5).alias(k) for i, k in enumerate(("q05", "q50", "q95"))])


@book("topk_suspicious", """WITH i AS (SELECT session_id, unit_id, CAST(t_us - lag(t_us) OVER (PARTITION BY session_id, unit_id ORDER BY t_us) AS DOUBLE) AS isi FROM sp),
s AS (SELECT session_id, unit_id, round(10 * coalesce(avg(CAST(isi < 2000 AS INT)), 0) + coalesce(avg(CAST(isi < 10000 AS INT)), 0) + coalesce(avg(CAST(isi > 1000000 AS INT)), 0), 6) AS score FROM i GROUP BY 1, 2)
SELECT session_id, unit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, unit_id) AS k FROM s) WHERE k <= 5""", "sp")
def _(d: Data) -> DataFrame:
    """The five most suspicious units of each session by a score of violations, bursts and silences."""
    q = models.unit_table(d).where("n_spikes > 0")
    part = lambda c: F.coalesce(c, F.lit(0.0))
    s = q.select(*UNIT, F.round(10 * part("isi_violation") + part("burst_index") + part("isi_long"), 6).alias("score"))
    k = F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("score"), "unit_id"))
    return s.withColumn("k", k).where("k <= 5").select(*UNIT, "score")


@book("cmp_count_matrix", "WITH hit AS (SELECT sp.session_id, sp.unit_id, tr.event_id, count(*) AS n FROM sp JOIN tr ON sp.session_id = tr.session_id AND t_us >= at_us AND t_us < at_us + 1000000 GROUP BY 1, 2, 3) SELECT us.session_id, us.unit_id, string_agg(CAST(coalesce(hit.n, 0) AS VARCHAR), ',' ORDER BY tr.event_id) AS row FROM us JOIN tr ON us.session_id = tr.session_id LEFT JOIN hit ON hit.session_id = us.session_id AND hit.unit_id = us.unit_id AND hit.event_id = tr.event_id GROUP BY 1, 2", "us sp tr")
def _(d: Data) -> DataFrame:
    """Units x trials: each unit's counts in the second after every trial, as one row of the session's matrix."""
    t = d.trial_rows().select("session_id", "event_id", "at_us")
    c = sk.interval.count_in_window(d.spikes(), d.unit_rows(), t, ["session_id"], ["unit_id"], ["event_id"], 0, 1_000_000)
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "n"))), lambda x: x["n"].cast("string")), ",")
    return c.groupBy(*UNIT).agg(row.alias("row"))


@book("cmp_active_ctx", "SELECT session_id, trial_id, CASE WHEN ctx <> 'active' THEN 'passive' WHEN lick_flag = 1 THEN 'active_lick' ELSE 'active_nolick' END AS label FROM tr", "tr")
def _(d: Data) -> DataFrame:
    label = F.when(F.col("ctx") != "active", "passive").when(F.col("lick_flag") == 1, "active_lick").otherwise("active_nolick")
    return d.trial_rows().select("session_id", "trial_id", label.alias("label"))


@book("cmp_conditions", "WITH c AS (SELECT ctx || '_' || split_part(trial_type, '_', 1) AS condition, session_id FROM tr WHERE trial_type IS NOT NULL) SELECT condition, CASE WHEN condition LIKE 'active%' THEN -1.0 ELSE -0.5 END::DOUBLE AS lo, CASE WHEN condition LIKE 'active%' THEN 3.0 ELSE 1.5 END::DOUBLE AS hi, count(*) AS n_trials, count(DISTINCT session_id) AS n_sessions FROM c GROUP BY 1", "tr")
def _(d: Data) -> DataFrame:
    """The conditions that occur, context by stimulus, with their windows."""
    c = d.trial_rows().where("trial_type is not null").select(F.concat_ws("_", "ctx", F.split_part("trial_type", F.lit("_"), F.lit(1))).alias("condition"), "session_id")
    active = F.col("condition").startswith("active")
    g = c.groupBy("condition").agg(F.count("*").alias("n_trials"), F.count_distinct("session_id").alias("n_sessions"))
    return g.select("condition", F.when(active, -1.0).otherwise(-0.5).alias("lo"), F.when(active, 3.0).otherwise(1.5).alias("hi"), "n_trials", "n_sessions")


@book("cmp_smooth_kernels", "WITH k AS (SELECT CAST(i AS INT) AS i, exp(-0.5 * (i / 1.0) * (i / 1.0)) AS e FROM (SELECT unnest(range(0, 4)) AS i)) SELECT i, round(e / sum(e) OVER (), 9) AS w FROM k")
def _(d: Data) -> DataFrame:
    """Weights of a half Gaussian of one bin over the present and three past bins."""
    return d.spark.createDataFrame([(i, round(w, 9)) for i, w in enumerate(hist.weights_gauss(1.0, 3, True))], "i int, w double")


@book("cmp_liu", "SELECT ccf_parent_acronym AS area, round(avg(CASE WHEN isnan(depth) THEN NULL ELSE depth END), 3) AS score FROM u WHERE ccf_parent_acronym IS NOT NULL AND ccf_parent_acronym <> '' GROUP BY 1", "u")
def _(d: Data) -> DataFrame:
    """A published table as it comes: lines of notes before the header, odd column names, text for missing numbers."""
    u = d.unit_rows("ccf_parent_acronym", "depth").where("ccf_parent_acronym is not null and ccf_parent_acronym <> ''")
    m = u.groupBy("ccf_parent_acronym").agg(F.round(F.avg(F.when(~F.isnan("depth"), F.col("depth"))), 3).alias("m"))
    path = scratch_dir(d.spark, "published")
    body = m.select(F.concat_ws("\t", "ccf_parent_acronym", F.coalesce(F.col("m").cast("string"), F.lit("n/a"))).alias("value"))
    notes = d.spark.createDataFrame([("# table of averages",), ("# not for citation",), ("Region\tAvg. score",)], "value string")
    notes.unionByName(body).write.text(path)
    raw = d.spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "Region\tAvg. score"))
    part = F.split("value", "\t")
    return raw.select(part[0].alias("area"), part[1].try_cast("double").alias("score"))


_BAR = co._RES + co._NC.format(v="res") + ", ar AS (SELECT DISTINCT session_id, unit_id, mouse_id, reward_group, ccf_parent_acronym AS area FROM units WHERE ccf_parent_acronym IS NOT NULL) SELECT a.area, a.reward_group, a.mouse_id, count(r) AS n, round(avg(r), 5) + 0.0 AS r FROM p JOIN ar a ON a.session_id = p.session_id AND a.unit_id = unit_a JOIN ar b ON b.session_id = p.session_id AND b.unit_id = unit_b WHERE a.area = b.area GROUP BY 1, 2, 3"


@book("cmp_nc_bar", _BAR, "us sp tr")
def _(d: Data) -> DataFrame:
    """Mean noise correlation within an area, per reward group and mouse."""
    u = d.unit_rows("mouse_id", "reward_group", "ccf_parent_acronym").where("ccf_parent_acronym is not null").withColumnRenamed("ccf_parent_acronym", "area")
    a = u.withColumnRenamed("unit_id", "unit_a")
    b = u.select("session_id", F.col("unit_id").alias("unit_b"), "area")
    p = co.noise_pairs(d).join(a, ["session_id", "unit_a"]).join(b, ["session_id", "unit_b", "area"])
    return p.groupBy("area", "reward_group", "mouse_id").agg(F.count("r").alias("n"), (F.round(F.avg("r"), 5) + 0.0).alias("r"))


@book("cmp_class_prop", "WITH s AS (SELECT session_id, CASE WHEN min(day) = 0 THEN 'learner' ELSE 'expert' END AS stage FROM units GROUP BY 1) SELECT roc.session_id, stage, analysis_type, count(*) AS n, round(100.0 * count(*) FILTER (significant) / count(*), 6) AS percent FROM roc JOIN s ON s.session_id = roc.session_id GROUP BY 1, 2, 3", "roc")
def _(d: Data) -> DataFrame:
    """Percent significant per session and analysis, with the session's stage of learning."""
    s = d.units.groupBy("session_id").agg(F.when(F.min("day") == 0, "learner").otherwise("expert").alias("stage"))
    g = d.roc().groupBy("session_id", "analysis_type").agg(F.count("*").alias("n"), F.count_if("significant").alias("k"))
    return g.join(s, "session_id").select("session_id", "stage", "analysis_type", "n", F.round(100.0 * F.col("k") / F.col("n"), 6).alias("percent"))


@book("cmp_metric_value", "WITH k AS (SELECT session_id, unit_id, min(CASE WHEN isnan(firing_rate) THEN NULL ELSE firing_rate END) AS value FROM units GROUP BY 1, 2) SELECT session_id, unit_id, value, row_number() OVER (PARTITION BY session_id ORDER BY value DESC NULLS LAST, unit_id) AS place FROM k")
def _(d: Data) -> DataFrame:
    """One metric of every unit and its place in the session; a unit without a value comes last."""
    k = d.units.groupBy(*UNIT).agg(F.min(F.when(~F.isnan("firing_rate"), F.col("firing_rate"))).alias("value"))
    return k.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc_nulls_last("value"), "unit_id")))


@book("cmp_index", "SELECT session_id, unit_id, dense_rank() OVER (PARTITION BY session_id ORDER BY unit_id) - 1 AS i FROM us", "us")
def _(d: Data) -> DataFrame:
    """A dense index of the units of each session, by value."""
    return d.unit_rows().withColumn("i", (F.dense_rank().over(W.partitionBy("session_id").orderBy("unit_id")) - 1).cast("long"))


@book("cmp_lick_events", "WITH j AS (SELECT session_id, event_id, at_us, lick_flag, reward_available, CASE WHEN NOT isnan(jaw_onset_time) THEN CAST(round(jaw_onset_time * 1000000) AS BIGINT) END AS jaw_us FROM tr) SELECT session_id, event_id, at_us AS t_us, 'trial' AS kind FROM j WHERE at_us IS NOT NULL UNION ALL SELECT session_id, event_id, jaw_us, CASE WHEN lick_flag = 1 AND reward_available = 1 THEN 'reward_lick' ELSE 'spontaneous' END FROM j WHERE jaw_us IS NOT NULL", "tr")
def _(d: Data) -> DataFrame:
    """The event map: trial starts, with the jaw's onsets appended as rewarded or spontaneous licks."""
    t = d.trial_rows()
    start = t.where("at_us is not null").select("session_id", "event_id", F.col("at_us").alias("t_us"), F.lit("trial").alias("kind"))
    kind = F.when((F.col("lick_flag") == 1) & (F.col("reward_available") == 1), "reward_lick").otherwise("spontaneous")
    return start.unionByName(t.select("session_id", "event_id", models.micros(F.col("jaw_onset_time")).alias("t_us"), kind.alias("kind")).where("t_us is not null"))


@book("cmp_scores", "WITH s AS (SELECT area, avg(x) AS score FROM (SELECT DISTINCT result_id, area, CASE WHEN isnan(shift_magnitude) THEN NULL ELSE shift_magnitude END AS x FROM neuron_results) GROUP BY 1) SELECT session_id, unit_id, round(s.score, 5) + 0.0 AS score, s.area IS NOT NULL AS known FROM u LEFT JOIN s ON s.area = u.ccf_parent_acronym", "u")
def _(d: Data) -> DataFrame:
    """Every unit with its area's score; an area without values keeps a null score but is known."""
    s = shifts(d).where("area is not null").groupBy("area").agg(F.avg("x").alias("score"))
    u = d.unit_rows("ccf_parent_acronym")
    return u.join(s, u["ccf_parent_acronym"] == s["area"], "left").select(*UNIT, (F.round("score", 5) + 0.0).alias("score"), F.col("area").isNotNull().alias("known"))


@book("cmp_waveform_join", "WITH w AS (SELECT session_id, unit_id, arg_min(kind, (registered_at, kind)) AS kind FROM (SELECT session_id, unit_id, registered_at, CASE WHEN waveformDuration_peakTrough < 400 THEN 'narrow' ELSE 'wide' END AS kind FROM units WHERE NOT isnan(waveformDuration_peakTrough) AND registered_at IS NOT NULL) GROUP BY 1, 2) SELECT us.session_id, us.unit_id, coalesce(w.kind, 'unknown') AS kind FROM us LEFT JOIN w ON w.session_id = us.session_id AND w.unit_id = us.unit_id", "us")
def _(d: Data) -> DataFrame:
    """Units with their waveform class: the first registered of several, ``unknown`` without one."""
    w = d.units.where("waveformDuration_peakTrough is not null and not isnan(waveformDuration_peakTrough) and registered_at is not null")
    w = w.withColumn("kind", F.when(F.col("waveformDuration_peakTrough") < 400, "narrow").otherwise("wide"))
    first = w.groupBy(*UNIT).agg(F.min_by("kind", F.struct("registered_at", "kind")).alias("kind"))
    return d.unit_rows().join(first, UNIT, "left").select(*UNIT, F.coalesce("kind", F.lit("unknown")).alias("kind"))


@book("src_synth_grid", f"SELECT CAST(unit_id AS BIGINT) AS unit_id, 'area' || CAST(unit_id % 7 AS VARCHAR) AS area, k.analysis, round({rs.draw_sql('(unit_id * 3 + k.j)', '1')} / {rs.P}.0 * 2 - 1, 6) AS selectivity FROM (SELECT unnest(range(0, 200)) AS unit_id), (SELECT unnest(['whisker', 'auditory', 'lick']) AS analysis, unnest([0, 1, 2]) AS j) k")
def _(d: Data) -> DataFrame:
    """A selectivity table by rule: 200 units in 7 areas, three analyses each, values by the arithmetic draw."""
    kinds = F.posexplode(F.array(*[F.lit(k) for k in ("whisker", "auditory", "lick")])).alias("j", "analysis")
    g = d.spark.range(200).select(F.col("id").alias("unit_id"), F.concat(F.lit("area"), (F.col("id") % 7).cast("string")).alias("area"), kinds)
    return g.select("unit_id", "area", "analysis", F.round(rs.draw(F.col("unit_id") * 3 + F.col("j"), F.lit(1)) / float(rs.P) * 2 - 1, 6).alias("selectivity"))


@book("cmp_inflection_io", "SELECT DISTINCT result_id, session_id, p_value, z_score FROM neuron_results WHERE session_id IS NOT NULL")
def _(d: Data) -> DataFrame:
    """Results saved as one folder of CSV files per session and all loaded again."""
    path = scratch_dir(d.spark, "inflection")
    n = d.neuron_results.where("session_id is not null").select("result_id", "session_id", "p_value", "z_score").distinct()
    n.withColumn("session", F.col("session_id")).write.partitionBy("session").option("header", "true").csv(path)
    return sources.read_any(d.spark, f"{path}/*/*.csv", "result_id long, session_id string, p_value double, z_score double")


QUERIES, ORACLE = book.queries, book.oracle
