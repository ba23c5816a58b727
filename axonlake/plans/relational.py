"""Filters, projections, joins, sorts, set operations and reshapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.operators import relational as rel
from axonlake.operators.interval import micros
from axonlake.plans.registry import Book, Data

book = Book()
EXCLUDED = ("root", "fiber tracts", "grey", "VS", "OT")
ALLOWED = {"wS1": ("SSp-bfd", "CP"), "wS2": ("SSp-bfd", "SSs", "ECT"), "A1": ("AUD", "TEa", "ECT"), "wM1": ("MOp",), "wM2": ("MOs",), "mPFC": ("ACAd", "PL", "ILA"), "tjM1": ("MOp", "MOs"), "DLS": ("CP",)}
OUTCOMES = {0: "whisker_miss", 1: "auditory_miss", 2: "whisker_hit", 3: "auditory_hit", 4: "correct_rejection", 5: "false_alarm", 6: "early_lick"}
ORDER = ["MOp", "MOs", "SSp-bfd", "SSs", "AUD", "CP"]

# ---- filters and projections


@book("flt_mouse_ref", "SELECT DISTINCT mouse_id, session_id, reward_group FROM u WHERE reward_group IN (0, 1) AND day = 0 AND mouse_id IN (SELECT mouse_id FROM trials WHERE perf = 6)", "u")
def _(d: Data) -> DataFrame:
    ok = d.trials.where("perf = 6").select("mouse_id").distinct()
    return d.units.where(F.col("reward_group").isin(0, 1) & (F.col("day") == 0)).select("mouse_id", "session_id", "reward_group").distinct().join(ok, "mouse_id", "left_semi")


@book("flt_trials_active", "SELECT session_id, trial_id FROM tr WHERE ctx = 'active' AND early_lick = 0 AND trial_type <> 'association'", "tr")
def _(d: Data) -> DataFrame:
    return d.trial_rows().where("ctx = 'active' and early_lick = 0 and trial_type <> 'association'").select("session_id", "trial_id")


@book("flt_task_trials", "SELECT session_id, trial_id FROM tr WHERE (trial_type IN ('whisker_trial', 'auditory_trial') OR lick_flag = 1) AND ctx <> 'passive' AND perf <> 6", "tr")
def _(d: Data) -> DataFrame:
    kind = F.col("trial_type").isin("whisker_trial", "auditory_trial") | (F.col("lick_flag") == 1)
    return d.trial_rows().where(kind & (F.col("ctx") != "passive") & (F.col("perf") != 6)).select("session_id", "trial_id")


_EVENTS = """SELECT session_id, ctx, e.event, e.t_at FROM tr, LATERAL (SELECT unnest([
 {event: CASE WHEN trial_type = 'whisker_trial' THEN 'whisker' END, t_at: at_us}, {event: CASE WHEN trial_type = 'auditory_trial' THEN 'auditory' END, t_at: at_us},
 {event: CASE WHEN trial_type = 'no_stim_trial' THEN 'no_stim' END, t_at: at_us}, {event: CASE WHEN trial_type = 'whisker_trial' AND lick_flag = 1 THEN 'whisker_hit' END, t_at: at_us},
 {event: CASE WHEN trial_type = 'auditory_trial' AND lick_flag = 1 THEN 'auditory_hit' END, t_at: at_us}, {event: CASE WHEN trial_type = 'no_stim_trial' AND lick_flag = 1 THEN 'spontaneous_lick' END, t_at: at_us},
 {event: 'jaw', t_at: CAST(round(CASE WHEN isnan(jaw_onset_time) THEN NULL ELSE jaw_onset_time END * 1000000) AS BIGINT)}]) AS e) WHERE e.event IS NOT NULL AND e.t_at IS NOT NULL"""


def event_rows(d: Data) -> DataFrame:
    """One row per event of seven kinds: session_id, ctx, event, t_at."""
    t, hit = F.col("trial_type"), F.col("lick_flag") == 1
    kinds = {"whisker": t == "whisker_trial", "auditory": t == "auditory_trial", "no_stim": t == "no_stim_trial", "whisker_hit": (t == "whisker_trial") & hit, "auditory_hit": (t == "auditory_trial") & hit, "spontaneous_lick": (t == "no_stim_trial") & hit}
    all_ = [F.struct(F.when(c, F.lit(k)).alias("event"), F.col("at_us").alias("t_at")) for k, c in kinds.items()] + [F.struct(F.lit("jaw").alias("event"), micros(F.col("jaw_onset_time")).alias("t_at"))]
    return d.trial_rows().select("session_id", "ctx", F.explode(F.array(*all_)).alias("e")).select("session_id", "ctx", "e.event", "e.t_at").where("event is not null and t_at is not null")


@book("flt_event_times", _EVENTS, "tr")
def _(d: Data) -> DataFrame:
    return event_rows(d)


@book("flt_select_trials", "SELECT session_id, trial_id, start_time FROM tr WHERE trial_type = 'whisker_trial' AND lick_flag = 1 AND ctx = 'active'", "tr")
def _(d: Data) -> DataFrame:
    return d.trial_rows().where("trial_type = 'whisker_trial' and lick_flag = 1 and ctx = 'active'").select("session_id", "trial_id", "start_time")


_QUALITY = "lower(trim(bc_label)) = 'good' AND presenceRatio > 0.8 AND firing_rate >= 2 AND NOT isnan(firing_rate) AND ccf_parent_acronym IS NOT NULL AND ccf_parent_acronym NOT IN ('root', 'fiber tracts', 'grey', 'VS', 'OT')"


def good_units(d: Data, *cols: str) -> DataFrame:
    u = d.unit_rows("bc_label", "presenceRatio", "firing_rate", "ccf_parent_acronym", *cols)
    rate = F.when(~F.isnan("firing_rate"), F.col("firing_rate"))
    return u.where((F.lower(F.trim("bc_label")) == "good") & (F.col("presenceRatio") > 0.8) & (rate >= 2) & ~F.col("ccf_parent_acronym").isin(*EXCLUDED))


@book("flt_unit_quality", f"SELECT session_id, unit_id FROM u WHERE {_QUALITY}", "u")
def _(d: Data) -> DataFrame:
    return good_units(d).select("session_id", "unit_id")


@book("flt_roc_sig", "SELECT result_id, direction FROM roc WHERE analysis_type = 'whisker_active' AND significant", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().where("analysis_type = 'whisker_active' and significant").select("result_id", "direction")


@book("flt_subject_prefix", "SELECT DISTINCT mouse_id, CAST(regexp_extract(mouse_id, '(\\d+)$', 1) AS INT) AS number FROM units WHERE mouse_id LIKE 'QX%' AND NOT (CAST(regexp_extract(mouse_id, '(\\d+)$', 1) AS INT) < 1)")
def _(d: Data) -> DataFrame:
    n = F.regexp_extract("mouse_id", r"(\d+)$", 1).try_cast("int")
    return d.units.select("mouse_id", n.alias("number")).where(F.col("mouse_id").startswith("QX") & ~(F.col("number") < 1)).distinct()


@book("flt_target_region", "SELECT session_id, unit_id FROM u WHERE " + " OR ".join(f"(target_region = '{k}' AND ccf_parent_acronym IN ({', '.join(repr(x) for x in v)}))" for k, v in ALLOWED.items()), "u")
def _(d: Data) -> DataFrame:
    rows = [(k, a) for k, v in ALLOWED.items() for a in v]
    dim = d.spark.createDataFrame(rows, "target_region string, ccf_parent_acronym string")  # a literal of the configuration
    return d.unit_rows("target_region", "ccf_parent_acronym").join(F.broadcast(dim), ["target_region", "ccf_parent_acronym"], "left_semi").select("session_id", "unit_id")


@book("flt_string_query", "SELECT result_id FROM roc WHERE significant AND selectivity > 0.2 AND area_acronym_custom IN ('CP', 'MOs') AND p_value < 0.01", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().filter("significant and selectivity > 0.2 and area_acronym_custom in ('CP', 'MOs') and p_value < 0.01").select("result_id")


@book("flt_clean", "SELECT DISTINCT result_id, TRY_CAST(shift_magnitude AS DOUBLE) + 0.0 AS x FROM neuron_results WHERE n_total_trials >= 50 AND shift_magnitude IS NOT NULL AND NOT isnan(shift_magnitude) AND area IS NOT NULL")
def _(d: Data) -> DataFrame:
    x = F.col("shift_magnitude").try_cast("double")
    return d.neuron_results.where("n_total_trials >= 50").select("result_id", "area", F.when(~F.isnan(x), x + 0.0).alias("x")).dropna().select("result_id", "x").distinct()


@book("prj_column_prefix", "SELECT COLUMNS('^(ccf_a|unit).*') FROM (SELECT DISTINCT unit_id, ccf_acronym, ccf_atlas_acronym, ccf_atlas_parent_acronym, ccf_ap FROM units)")
def _(d: Data) -> DataFrame:
    u = d.units
    return u.select(*[c for c in u.columns if c.startswith(("ccf_a", "unit"))]).distinct()


@book("prj_outcome_map", "SELECT session_id, trial_id, CASE perf " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in OUTCOMES.items()) + " END AS outcome FROM tr", "tr")
def _(d: Data) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    return d.trial_rows().select("session_id", "trial_id", m[F.col("perf")].alias("outcome"))


@book("prj_cast", "SELECT session_id, trial_id, CAST(perf AS DOUBLE) AS perf_f, CAST(lick_flag AS BOOLEAN) AS lick, CAST(trial_id AS VARCHAR) AS trial, TRY_CAST(trial_type AS INT) AS no_number FROM tr", "tr")
def _(d: Data) -> DataFrame:
    return d.trial_rows().select("session_id", "trial_id", F.col("perf").cast("double").alias("perf_f"), F.col("lick_flag").cast("boolean").alias("lick"), F.col("trial_id").cast("string").alias("trial"), F.col("trial_type").try_cast("int").alias("no_number"))


# ---- joins


@book("join_anti_drift", "WITH drift AS (SELECT DISTINCT mouse_id, session_id, electrode_group, cluster_id FROM u WHERE presenceRatio < 0.7) SELECT session_id, unit_id FROM u WHERE NOT EXISTS (SELECT 1 FROM drift x WHERE x.mouse_id = u.mouse_id AND x.session_id = u.session_id AND x.electrode_group = u.electrode_group AND x.cluster_id = u.cluster_id)", "u")
def _(d: Data) -> DataFrame:
    keys = ["mouse_id", "session_id", "electrode_group", "cluster_id"]
    u = d.unit_rows("presenceRatio", *keys)
    return u.join(u.where("presenceRatio < 0.7").select(*keys).distinct(), keys, "left_anti").select("session_id", "unit_id")


@book("join_semi_valid", "WITH ok AS (SELECT area_acronym_custom, analysis_type FROM roc GROUP BY 1, 2 HAVING count(DISTINCT mouse_id) >= 2) SELECT result_id FROM roc JOIN ok USING (area_acronym_custom, analysis_type)", "roc")
def _(d: Data) -> DataFrame:
    return rel.supported(d.roc(), ["area_acronym_custom", "analysis_type"], {"mouse_id": 2}).select("result_id")


@book("join_left_dim", "WITH l AS (SELECT mouse_id, min(inflection_trial) AS learning_trial FROM neuron_results GROUP BY 1) SELECT session_id, trial_id, learning_trial, reward_group FROM tr LEFT JOIN l USING (mouse_id) LEFT JOIN (SELECT mouse_id, min(reward_group) AS reward_group FROM units GROUP BY 1) USING (mouse_id)", "tr")
def _(d: Data) -> DataFrame:
    learning = d.neuron_results.groupBy("mouse_id").agg(F.min("inflection_trial").alias("learning_trial"))
    group = d.units.groupBy("mouse_id").agg(F.min("reward_group").alias("reward_group"))
    return d.trial_rows().join(learning, "mouse_id", "left").join(group, "mouse_id", "left").select("session_id", "trial_id", "learning_trial", "reward_group")


_MOD = "WITH a AS (SELECT session_id, neuron_id, round(avg(selectivity), 6) AS sel FROM roc WHERE analysis_type = '{x}' AND neuron_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT session_id, neuron_id, round(avg(selectivity), 6) AS sel FROM roc WHERE analysis_type = '{y}' AND neuron_id IS NOT NULL GROUP BY 1, 2) "


def _modality(d: Data, kind: str) -> DataFrame:
    r = d.roc().where((F.col("analysis_type") == kind) & F.col("neuron_id").isNotNull())
    return r.groupBy("session_id", "neuron_id").agg(F.round(F.avg("selectivity"), 6).alias("sel"))


@book("join_inner_modalities", _MOD.format(x="whisker_active", y="auditory_active") + "SELECT session_id, neuron_id, a.sel AS sel_whisker, b.sel AS sel_auditory FROM a JOIN b USING (session_id, neuron_id)", "roc")
def _(d: Data) -> DataFrame:
    a, b = _modality(d, "whisker_active").withColumnRenamed("sel", "sel_whisker"), _modality(d, "auditory_active").withColumnRenamed("sel", "sel_auditory")
    return a.join(b, ["session_id", "neuron_id"])


@book("join_index_align", _MOD.format(x="whisker_passive_pre", y="whisker_passive_post") + "SELECT session_id, neuron_id, a.sel AS pre, b.sel AS post FROM a JOIN b USING (session_id, neuron_id) WHERE a.sel IS NOT NULL AND b.sel IS NOT NULL", "roc")
def _(d: Data) -> DataFrame:
    a, b = _modality(d, "whisker_passive_pre").withColumnRenamed("sel", "pre"), _modality(d, "whisker_passive_post").withColumnRenamed("sel", "post")
    return a.join(b, ["session_id", "neuron_id"]).dropna()


@book("join_outer_audit", "WITH a AS (SELECT mouse_id, neuron_id, count(*) AS n FROM u WHERE neuron_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT mouse_id, neuron_id, count(*) AS n FROM (SELECT DISTINCT result_id, mouse_id, neuron_id FROM neuron_results) WHERE neuron_id IS NOT NULL GROUP BY 1, 2) SELECT coalesce(a.mouse_id, b.mouse_id) AS mouse_id, coalesce(a.neuron_id, b.neuron_id) AS neuron_id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.mouse_id = b.mouse_id AND a.neuron_id = b.neuron_id", "u")
def _(d: Data) -> DataFrame:
    known = F.col("neuron_id").isNotNull()
    return rel.outer_audit(d.unit_rows("mouse_id", "neuron_id").where(known), d.neuron_results.select("result_id", "mouse_id", "neuron_id").distinct().where(known), ["mouse_id", "neuron_id"])


@book("join_one_to_one", "WITH m AS (SELECT unit_id, max(len(spike_times)) AS n_spikes FROM u GROUP BY 1) SELECT u.session_id, unit_id, n_spikes FROM u LEFT JOIN m USING (unit_id)", "u")
def _(d: Data) -> DataFrame:
    m = d.unit_rows("spike_times").groupBy("unit_id").agg(F.max(F.size(F.col("spike_times"))).alias("_n")).select("unit_id", F.when(F.col("_n") >= 0, F.col("_n")).alias("n_spikes"))
    return rel.one_to_one(d.unit_rows(), m, ["unit_id"]).select("session_id", "unit_id", "n_spikes")


@book("join_full_ref", "WITH g AS (SELECT DISTINCT result_id, mouse_id, neuron_id, fold, git_version, model_name, test_score FROM glm_results WHERE neuron_id IS NOT NULL), f AS (SELECT mouse_id, neuron_id, fold, git_version, max(test_score) AS full_score FROM g WHERE model_name = 'full' GROUP BY 1, 2, 3, 4) SELECT result_id, full_score FROM g LEFT JOIN f USING (mouse_id, neuron_id, fold, git_version)")
def _(d: Data) -> DataFrame:
    g = glm(d)
    w = W.partitionBy("mouse_id", "neuron_id", "fold", "git_version")
    return g.withColumn("full_score", F.max(F.when(F.col("model_name") == "full", F.col("test_score"))).over(w)).select("result_id", "full_score")


def glm(d: Data) -> DataFrame:
    g = d.glm_results.select("result_id", "mouse_id", "neuron_id", "fold", "git_version", "model_name", "test_score", "test_corr").where("neuron_id is not null").distinct()
    return g.withColumn("test_corr", F.when(~F.isnan("test_corr"), F.col("test_corr")))


@book("win_group_delta", "WITH g AS (SELECT DISTINCT result_id, mouse_id, neuron_id, fold, git_version, model_name, test_score FROM glm_results WHERE neuron_id IS NOT NULL), f AS (SELECT *, max(CASE WHEN model_name = 'full' THEN test_score END) OVER (PARTITION BY mouse_id, neuron_id, fold, git_version) AS f FROM g) SELECT result_id, round(test_score - f, 6) AS delta, round((f - test_score) / nullif(f, 0), 6) AS relative FROM f WHERE model_name <> 'full'")
def _(d: Data) -> DataFrame:
    w = W.partitionBy("mouse_id", "neuron_id", "fold", "git_version")
    g = glm(d).withColumn("f", F.max(F.when(F.col("model_name") == "full", F.col("test_score"))).over(w)).where("model_name <> 'full'")
    return g.select("result_id", F.round(F.col("test_score") - F.col("f"), 6).alias("delta"), F.round(F.try_divide(F.col("f") - F.col("test_score"), F.nullif(F.col("f"), F.lit(0.0))), 6).alias("relative"))


_DOM = """WITH s AS (SELECT session_id, area_acronym_custom AS area, direction, count(*) AS n FROM roc WHERE analysis_type = 'whisker_active' AND significant AND area_acronym_custom IS NOT NULL AND direction IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT session_id, area_acronym_custom AS area FROM roc WHERE analysis_type = 'whisker_active' AND area_acronym_custom IS NOT NULL AND session_id IS NOT NULL), dir AS (SELECT unnest(['positive', 'negative']) AS direction)
SELECT g.session_id, g.area, dir.direction, coalesce(s.n, 0) AS n FROM g CROSS JOIN dir LEFT JOIN s ON s.session_id = g.session_id AND s.area = g.area AND s.direction = dir.direction"""


@book("join_cross_expand", _DOM, "roc")
def _(d: Data) -> DataFrame:
    r = d.roc().where("analysis_type = 'whisker_active' and area_acronym_custom is not null and session_id is not null").withColumnRenamed("area_acronym_custom", "area")
    spine = r.select("session_id", "area").distinct().withColumn("direction", F.explode(F.array(F.lit("positive"), F.lit("negative"))))
    return rel.fill_domain(r.where("significant and direction is not null").groupBy("session_id", "area", "direction").agg(F.count("*").alias("n")), spine, ["session_id", "area", "direction"], ["n"])


@book("join_cartesian_domain", """WITH m AS (SELECT DISTINCT mouse_id FROM roc WHERE mouse_id IS NOT NULL), a AS (SELECT DISTINCT area_acronym_custom AS area FROM roc WHERE area_acronym_custom IS NOT NULL), t AS (SELECT DISTINCT analysis_type FROM roc WHERE analysis_type IS NOT NULL),
n AS (SELECT mouse_id, area_acronym_custom AS area, analysis_type, count(*) AS n FROM roc WHERE significant GROUP BY 1, 2, 3) SELECT m.mouse_id, a.area, t.analysis_type, coalesce(n.n, 0) AS n FROM m, a, t LEFT JOIN n ON n.mouse_id = m.mouse_id AND n.area = a.area AND n.analysis_type = t.analysis_type""", "roc")
def _(d: Data) -> DataFrame:
    r = d.roc().withColumnRenamed("area_acronym_custom", "area")
    keys = ["mouse_id", "area", "analysis_type"]
    return rel.fill_domain(r.where("significant").groupBy(*keys).agg(F.count("*").alias("n")), rel.domain(r, *[[k] for k in keys]), keys, ["n"])


@book("join_pairs", "SELECT a.session_id, a.unit_id AS id_a, b.unit_id AS id_b FROM us a JOIN us b ON a.session_id = b.session_id AND a.unit_id < b.unit_id", "us")
def _(d: Data) -> DataFrame:
    return rel.pairs(d.unit_rows(), ["session_id"], "unit_id")


@book("join_pairs_within", "WITH x AS (SELECT DISTINCT session_id, unit_id, ccf_parent_acronym AS area FROM u WHERE ccf_parent_acronym IS NOT NULL) SELECT a.session_id, a.unit_id AS id_a, b.unit_id AS id_b, a.area AS area_a, b.area AS area_b FROM x a JOIN x b ON a.session_id = b.session_id AND a.unit_id < b.unit_id AND a.area = b.area", "u")
def _(d: Data) -> DataFrame:
    return rel.pairs(d.unit_rows("ccf_parent_acronym").withColumnRenamed("ccf_parent_acronym", "area").dropna(), ["session_id"], "unit_id", same=["area"])


_AP = "WITH q AS (SELECT mouse_id, ccf_parent_acronym AS area, count(DISTINCT unit_id) AS n FROM u WHERE ccf_parent_acronym IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT unit_id) >= 2) "


def _areas_of_mice(d: Data) -> DataFrame:
    u = d.unit_rows("mouse_id", "ccf_parent_acronym").withColumnRenamed("ccf_parent_acronym", "area").where("area is not null")
    return u.groupBy("mouse_id", "area").agg(F.count_distinct("unit_id").alias("n")).where("n >= 2")


@book("join_pairs_repl", _AP + "SELECT a.mouse_id, a.area AS id_a, b.area AS id_b FROM q a JOIN q b ON a.mouse_id = b.mouse_id AND a.area <= b.area", "u")
def _(d: Data) -> DataFrame:
    return rel.pairs(_areas_of_mice(d), ["mouse_id"], "area", repeated=True)


@book("agg_area_pairs", _AP + "SELECT a.area AS id_a, b.area AS id_b, count(*) AS n_mice FROM q a JOIN q b ON a.mouse_id = b.mouse_id AND a.area <= b.area GROUP BY 1, 2", "u")
def _(d: Data) -> DataFrame:
    return rel.pairs(_areas_of_mice(d), ["mouse_id"], "area", repeated=True).groupBy("id_a", "id_b").agg(F.count("*").alias("n_mice"))


_SCORE = [("SSp-bfd", 0.2), ("MOs", 0.7), ("CP", 0.5), ("MOp", 0.4), ("AUD1", 0.9)]


@book("join_fallback_map", f"WITH s AS (SELECT * FROM (VALUES {', '.join(str(x) for x in _SCORE)}) t(name, score)) SELECT session_id, unit_id, CAST(coalesce(a.score, b.score) AS DOUBLE) AS score FROM u LEFT JOIN s a ON a.name = ccf_acronym LEFT JOIN s b ON b.name = ccf_parent_acronym", "u")
def _(d: Data) -> DataFrame:
    s = d.spark.createDataFrame(_SCORE, "name string, score double")
    return rel.lookup(d.unit_rows("ccf_acronym", "ccf_parent_acronym"), "ccf_acronym", "ccf_parent_acronym", s, "name", "score").select("session_id", "unit_id", "score")


@book("join_hierarchy", f"WITH s AS (SELECT name, avg(score) AS score FROM (VALUES {', '.join(str(x) for x in _SCORE)}) t(name, score) GROUP BY 1) SELECT ccf_parent_acronym AS area, count(*) AS n, CAST(any_value(score) AS DOUBLE) AS score, round(ln(CAST(any_value(score) AS DOUBLE) + 1e-5), 6) AS log_score FROM u LEFT JOIN s ON s.name = ccf_parent_acronym GROUP BY 1", "u")
@book("cmp_anatomy_merge", f"WITH s AS (SELECT name, avg(score) AS score FROM (VALUES {', '.join(str(x) for x in _SCORE)}) t(name, score) GROUP BY 1) SELECT ccf_parent_acronym AS area, count(*) AS n, CAST(any_value(score) AS DOUBLE) AS score, round(ln(CAST(any_value(score) AS DOUBLE) + 1e-5), 6) AS log_score FROM u LEFT JOIN s ON s.name = ccf_parent_acronym GROUP BY 1", "u")
def _(d: Data) -> DataFrame:
    s = d.spark.createDataFrame(_SCORE, "area string, score double").groupBy("area").agg(F.avg("score").alias("score"))
    n = d.unit_rows("ccf_parent_acronym").groupBy(F.col("ccf_parent_acronym").alias("area")).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(s), "area", "left").withColumn("log_score", F.round(F.ln(F.col("score") + 1e-5), 6))


@book("join_topk_attach", "WITH b AS (SELECT result_id, abs(selectivity) AS s FROM roc WHERE selectivity IS NOT NULL ORDER BY s DESC, result_id LIMIT 50) SELECT b.result_id, round(s, 6) AS s, area_acronym_custom FROM b JOIN roc USING (result_id)", "roc")
def _(d: Data) -> DataFrame:
    r = d.roc()
    best = rel.top(r.where("selectivity is not null").select("result_id", F.abs("selectivity").alias("s")), 50, F.desc("s"), F.asc("result_id"))
    return best.join(r.select("result_id", "area_acronym_custom"), "result_id").withColumn("s", F.round("s", 6))


# ---- sorts, limits, samples


@book("srt_multi", "SELECT area_acronym_custom, analysis_type, n, row_number() OVER (ORDER BY area_acronym_custom, n DESC, analysis_type) AS place FROM (SELECT area_acronym_custom, analysis_type, count(*) AS n FROM roc WHERE area_acronym_custom IS NOT NULL AND analysis_type IS NOT NULL GROUP BY 1, 2)", "roc")
def _(d: Data) -> DataFrame:
    n = d.roc().where("area_acronym_custom is not null and analysis_type is not null").groupBy("area_acronym_custom", "analysis_type").agg(F.count("*").alias("n"))
    # a bounded table of labels, not of rows: one task may rank it
    return n.withColumn("place", F.row_number().over(W.orderBy("area_acronym_custom", F.desc("n"), "analysis_type"))).orderBy("place")


@book("srt_custom_order", "SELECT area, n, row_number() OVER (ORDER BY CASE WHEN list_position([" + ", ".join(f"'{x}'" for x in ORDER) + "], area) > 0 THEN list_position([" + ", ".join(f"'{x}'" for x in ORDER) + "], area) ELSE 99 END, area) AS place FROM (SELECT ccf_parent_acronym AS area, count(*) AS n FROM u WHERE ccf_parent_acronym IS NOT NULL GROUP BY 1)", "u")
@book("cmp_group_order", "SELECT area, n, row_number() OVER (ORDER BY CASE WHEN list_position([" + ", ".join(f"'{x}'" for x in ORDER) + "], area) > 0 THEN list_position([" + ", ".join(f"'{x}'" for x in ORDER) + "], area) ELSE 99 END, area) AS place FROM (SELECT ccf_parent_acronym AS area, count(*) AS n FROM u WHERE ccf_parent_acronym IS NOT NULL GROUP BY 1)", "u")
def _(d: Data) -> DataFrame:
    n = d.unit_rows("ccf_parent_acronym").where("ccf_parent_acronym is not null").groupBy(F.col("ccf_parent_acronym").alias("area")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(rel.order_rank(F.col("area"), ORDER), "area")))


@book("topk_abs", "SELECT result_id, round(selectivity, 6) AS selectivity FROM roc WHERE selectivity IS NOT NULL ORDER BY abs(selectivity) DESC, result_id LIMIT 100", "roc")
def _(d: Data) -> DataFrame:
    return rel.top(d.roc().where("selectivity is not null"), 100, F.desc(F.abs("selectivity")), F.asc("result_id")).select("result_id", F.round("selectivity", 6).alias("selectivity"))


@book("topk_uncertain", "SELECT result_id, round(auc, 6) AS auc FROM roc WHERE auc IS NOT NULL ORDER BY abs(auc - 0.5), result_id LIMIT 100", "roc")
@book("cmp_uncertain", "SELECT result_id, round(auc, 6) AS auc FROM roc WHERE auc IS NOT NULL ORDER BY abs(auc - 0.5), result_id LIMIT 100", "roc")
def _(d: Data) -> DataFrame:
    return rel.top(d.roc().where("auc is not null"), 100, F.asc(F.abs(F.col("auc") - 0.5)), F.asc("result_id")).select("result_id", F.round("auc", 6).alias("auc"))


_PRIOR = "auc * 0.2 / 0.5 / (auc * 0.2 / 0.5 + (1 - auc) * 0.8 / 0.5)"


def prior_shift(p, train: float, true: float):
    """Probability ``p`` of a classifier trained at prior ``train``, for data with prior ``true``."""
    a, b = p * true / train, (1 - p) * (1 - true) / (1 - train)
    return a / (a + b)


@book("topk_prior", f"SELECT result_id, round({_PRIOR}, 6) AS p FROM roc WHERE auc IS NOT NULL ORDER BY round({_PRIOR}, 9) DESC, result_id LIMIT 100", "roc")
def _(d: Data) -> DataFrame:
    r = d.roc().where("auc is not null").withColumn("q", prior_shift(F.col("auc"), 0.5, 0.2))
    return rel.top(r, 100, F.desc(F.round("q", 9)), F.asc("result_id")).select("result_id", F.round("q", 6).alias("p"))


@book("fit_prior_shift", f"SELECT result_id, round({_PRIOR}, 6) AS p FROM roc WHERE auc IS NOT NULL", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().where("auc is not null").select("result_id", F.round(prior_shift(F.col("auc"), 0.5, 0.2), 6).alias("p"))


@book("lim_first_n_events", "SELECT session_id, trial_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, trial_type ORDER BY at_us, trial_id) AS k FROM tr) WHERE k <= 5", "tr")
def _(d: Data) -> DataFrame:
    return rel.top_per(d.trial_rows(), ["session_id", "trial_type"], 5, F.asc("at_us"), F.asc("trial_id")).select("session_id", "trial_id")


@book("smp_kfold", "SELECT session_id, trial_id, ((trial_id * 7919 + 3 * 104729 + 12345) % 1000003) % 5 AS fold FROM tr", "tr")
def _(d: Data) -> DataFrame:
    return d.trial_rows().select("session_id", "trial_id", rel.fold_of(F.col("trial_id"), 5, 3).alias("fold"))


@book("smp_rows", "SELECT session_id, unit_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY (unit_id * 7919 + 12345) % 1000003, unit_id) AS k FROM us) WHERE k <= 10", "us")
def _(d: Data) -> DataFrame:
    return rel.top_per(d.unit_rows(), ["session_id"], 10, F.asc(rel.fold_of(F.col("unit_id"), 1000003)), F.asc("unit_id"))


# ---- sets and shapes


@book("set_union_all", "SELECT mouse_id, neuron_id, area, NULL AS fold FROM neuron_results UNION ALL SELECT mouse_id, neuron_id, NULL, fold FROM glm_results")
def _(d: Data) -> DataFrame:
    return d.neuron_results.select("mouse_id", "neuron_id", "area").unionByName(d.glm_results.select("mouse_id", "neuron_id", "fold"), allowMissingColumns=True)


_SETS = "SELECT DISTINCT area_acronym_custom AS area FROM units WHERE reward_group = 0 AND area_acronym_custom IS NOT NULL {op} SELECT DISTINCT area_acronym_custom FROM units WHERE reward_group = 1 AND area_acronym_custom IS NOT NULL"


def _area_sets(d: Data) -> tuple[DataFrame, DataFrame]:
    u = d.units.where("area_acronym_custom is not null").withColumnRenamed("area_acronym_custom", "area")
    return u.where("reward_group = 0").select("area"), u.where("reward_group = 1").select("area")


@book("set_intersect", _SETS.format(op="INTERSECT"))
def _(d: Data) -> DataFrame:
    a, b = _area_sets(d)
    return a.intersect(b)


@book("set_union", _SETS.format(op="UNION"))
def _(d: Data) -> DataFrame:
    a, b = _area_sets(d)
    return a.union(b).distinct()


@book("set_except", _SETS.format(op="EXCEPT"))
def _(d: Data) -> DataFrame:
    a, b = _area_sets(d)
    return a.subtract(b)


@book("dedup", "SELECT session_id, imec_id, cluster_id, min(unit_id) AS unit_id FROM units GROUP BY 1, 2, 3")
def _(d: Data) -> DataFrame:
    return d.units.groupBy("session_id", "imec_id", "cluster_id").agg(F.min("unit_id").alias("unit_id"))


@book("dup_report", "SELECT unit_id, count(*) AS n FROM units GROUP BY 1 HAVING count(*) > 1")
def _(d: Data) -> DataFrame:
    return d.units.groupBy("unit_id").agg(F.count("*").alias("n")).where("n > 1")


@book("pivot_wide", "SELECT session_id, neuron_id, round(avg(selectivity) FILTER (analysis_type = 'whisker_active'), 6) AS whisker_active, round(avg(selectivity) FILTER (analysis_type = 'auditory_active'), 6) AS auditory_active FROM roc WHERE analysis_type IN ('whisker_active', 'auditory_active') GROUP BY 1, 2", "roc")
def _(d: Data) -> DataFrame:
    kinds = ["whisker_active", "auditory_active"]
    p = d.roc().where(F.col("analysis_type").isin(kinds)).groupBy("session_id", "neuron_id").pivot("analysis_type", kinds).agg(F.avg("selectivity"))
    return p.select("session_id", "neuron_id", *[F.round(k, 6).alias(k) for k in kinds])


@book("unnest_arrays", "SELECT unit_id, unnest(range(0, len(waveform_mean))) AS pos, unnest(waveform_mean) + 0.0 AS v FROM (SELECT DISTINCT unit_id, waveform_mean FROM units)")
def _(d: Data) -> DataFrame:
    u = d.unit_rows("waveform_mean").select("unit_id", "waveform_mean").distinct()
    return u.select("unit_id", F.posexplode(F.arrays_zip("waveform_mean")).alias("pos", "z")).select("unit_id", F.col("pos").cast("long").alias("pos"), (F.col("z.waveform_mean") + 0.0).alias("v"))


@book("unnest_trials", "SELECT us.session_id, unit_id, trial_id, trial_type FROM us JOIN tr USING (session_id)", "us tr")
def _(d: Data) -> DataFrame:
    return d.unit_rows().join(d.trial_rows().select("session_id", "trial_id", "trial_type"), "session_id")


@book("nest_list", "SELECT mouse_id, string_agg(area, ',' ORDER BY area) AS areas, count(*) AS n FROM (SELECT DISTINCT mouse_id, ccf_parent_acronym AS area FROM units WHERE ccf_parent_acronym IS NOT NULL) GROUP BY 1")
def _(d: Data) -> DataFrame:
    s = d.units.where("ccf_parent_acronym is not null").groupBy("mouse_id").agg(F.array_sort(F.collect_set("ccf_parent_acronym")).alias("s"))
    return s.select("mouse_id", F.array_join("s", ",").alias("areas"), F.size("s").alias("n"))


@book("mirror_matrix", _AP + ", p AS (SELECT a.area AS id_a, b.area AS id_b, count(*) AS n_mice FROM q a JOIN q b ON a.mouse_id = b.mouse_id AND a.area <= b.area GROUP BY 1, 2) SELECT * FROM p UNION ALL SELECT id_b, id_a, n_mice FROM p WHERE id_a <> id_b", "u")
def _(d: Data) -> DataFrame:
    p = rel.pairs(_areas_of_mice(d), ["mouse_id"], "area", repeated=True).groupBy("id_a", "id_b").agg(F.count("*").alias("n_mice"))
    return rel.mirror(p, "id_a", "id_b")


QUERIES, ORACLE = book.queries, book.oracle
