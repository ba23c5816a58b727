"""Aggregations with minimum support, AUC and rank tests, proportions, focality, false-discovery control."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.functions import special
from axonlake.operators import interval, relational as rel, stats
from axonlake.plans.registry import Book, Data
from axonlake.plans.relational import glm

book = Book()
S = 1_000_000
AREA = "area_acronym_custom"

# counts before (class 0) and after (class 1) each trial's start, per unit and analysis
_CNT = """WITH ev AS (SELECT *, CASE WHEN trial_type = 'whisker_trial' THEN 'whisker_active' ELSE 'auditory_active' END AS analysis FROM tr WHERE ctx = 'active' AND trial_type <> 'no_stim_trial'),
hit AS (SELECT sp.session_id, sp.unit_id, ev.event_id, count(*) FILTER (t_us < at_us) AS pre, count(*) FILTER (t_us >= at_us) AS post FROM sp JOIN ev ON sp.session_id = ev.session_id AND t_us >= at_us - 2000000 AND t_us <= at_us + 2000000 GROUP BY 1, 2, 3),
c AS (SELECT us.session_id, us.unit_id, ev.analysis, ev.event_id, ev.lick_flag, coalesce(pre, 0) AS pre, coalesce(post, 0) AS post FROM us JOIN ev ON us.session_id = ev.session_id LEFT JOIN hit ON hit.session_id = us.session_id AND hit.unit_id = us.unit_id AND hit.event_id = ev.event_id),
x AS (SELECT session_id, unit_id, analysis, pre AS v, 0 AS cls FROM c UNION ALL SELECT session_id, unit_id, analysis, post, 1 FROM c)
"""
_RANK = _CNT + """, r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY session_id, unit_id, analysis, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY session_id, unit_id, analysis, v) AS t FROM x WINDOW w AS (PARTITION BY session_id, unit_id, analysis ORDER BY v)),
g AS (SELECT session_id, unit_id, analysis, sum(rk) FILTER (cls = 1) AS r1, count(*) FILTER (cls = 1) AS n1, count(*) FILTER (cls = 0) AS n0, count(DISTINCT v) AS k, sum(t * t - 1.0) AS ties FROM r GROUP BY 1, 2, 3)
"""
BY = ["session_id", "unit_id", "analysis"]


def response_counts(d: Data) -> DataFrame:
    """Spikes in the two seconds before and after each stimulus: session, unit, analysis, event, lick_flag, pre, post; zeros included."""
    ev = d.trial_rows().where("ctx = 'active' and trial_type <> 'no_stim_trial'")
    ev = ev.select("session_id", "event_id", "at_us", "lick_flag", F.when(F.col("trial_type") == "whisker_trial", "whisker_active").otherwise("auditory_active").alias("analysis"))
    near = interval.range_join(d.spikes(), ev, ["session_id"], -2 * S, 2 * S, "both")
    hits = near.groupBy("session_id", "unit_id", "event_id").agg(F.count_if(F.col("t_us") < F.col("at_us")).alias("pre"), F.count_if(F.col("t_us") >= F.col("at_us")).alias("post"))
    spine = d.unit_rows().join(ev.drop("at_us"), "session_id")
    c = spine.join(hits, ["session_id", "unit_id", "event_id"], "left")
    return c.withColumns({k: F.coalesce(k, F.lit(0)) for k in ("pre", "post")})


def two_classes(c: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("pre").alias("v"), F.lit(False).alias("cls")), F.struct(F.col("post").alias("v"), F.lit(True).alias("cls")))
    return c.select(*BY, F.explode(both).alias("e")).select(*BY, "e.v", "e.cls")


def unit_auc(d: Data) -> DataFrame:
    return stats.auc(two_classes(response_counts(d)), BY, "v", F.col("cls"))


@book("agg_auc", _RANK + "SELECT session_id, unit_id, analysis, n1, n0, round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc, round(2 * (r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0) - 1, 6) AS selectivity FROM g", "us sp tr")
def _(d: Data) -> DataFrame:
    return unit_auc(d).withColumns({c: F.round(c, 6) for c in ("auc", "selectivity")})


@book("agg_roc_curve", _CNT + """, v AS (SELECT session_id, unit_id, analysis, v AS threshold, count(*) FILTER (cls = 1) AS a, count(*) FILTER (cls = 0) AS b FROM x GROUP BY 1, 2, 3, 4)
SELECT session_id, unit_id, analysis, CAST(threshold AS DOUBLE) AS threshold, round(sum(a) OVER d / sum(a) OVER g, 6) AS tpr, round(sum(b) OVER d / sum(b) OVER g, 6) AS fpr FROM v
WINDOW d AS (PARTITION BY session_id, unit_id, analysis ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), g AS (PARTITION BY session_id, unit_id, analysis)""", "us sp tr")
def _(d: Data) -> DataFrame:
    return stats.roc_curve(two_classes(response_counts(d)), BY, "v", F.col("cls")).withColumns({c: F.round(c, 6) for c in ("tpr", "fpr")})


@book("agg_select_counts", _CNT + """, m AS (SELECT session_id, unit_id, event_id, CASE WHEN analysis = 'whisker_active' THEN 'whisker_choice' ELSE 'choice' END AS analysis, lick_flag AS cls, post AS v FROM c)
SELECT session_id, unit_id, analysis, cls, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM m GROUP BY 1, 2, 3, 4""", "us sp tr")
def _(d: Data) -> DataFrame:
    m = response_counts(d).withColumn("analysis", F.when(F.col("analysis") == "whisker_active", "whisker_choice").otherwise("choice"))
    return m.groupBy(*BY, F.col("lick_flag").alias("cls")).agg(F.count("*").alias("n"), F.sum("post").alias("total"))


@book("stat_ranksum", _RANK + ", z AS (SELECT *, CASE WHEN k = 1 THEN 0.0 ELSE (r1 - n1 * (n1 + n0 + 1) / 2.0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0) END AS z FROM g) SELECT session_id, unit_id, analysis, n1, n0, round(z, 6) + 0.0 AS z, round(" + special.erfc_sql("abs(z) / sqrt(2.0)") + ", 6) AS p FROM z", "us sp tr")
def _(d: Data) -> DataFrame:
    return stats.rank_sum(two_classes(response_counts(d)), BY, "v", F.col("cls")).select(*BY, "n1", "n0", (F.round("z", 6) + 0.0).alias("z"), F.round("p", 6).alias("p"))


@book("stat_mwu", _RANK + ", z AS (SELECT *, r1 - n1 * (n1 + 1) / 2.0 AS u, n1 * n0 / 12.0 * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1.0))) AS var FROM g), y AS (SELECT *, CASE WHEN var > 1e-12 THEN greatest(abs(u - n1 * n0 / 2.0) - 0.5, 0) / sqrt(var) END AS z FROM z) SELECT session_id, unit_id, analysis, n1, n0, u, round(least(" + special.erfc_sql("abs(z) / sqrt(2.0)") + ", 1), 6) AS p FROM y", "us sp tr")
def _(d: Data) -> DataFrame:
    return stats.mann_whitney(two_classes(response_counts(d)), BY, "v", F.col("cls")).withColumn("p", F.round("p", 6))


@book("stat_wilcoxon", _CNT + """, d AS (SELECT session_id, unit_id, analysis, post - pre AS d FROM c WHERE post <> pre), r AS (SELECT *, rank() OVER (PARTITION BY session_id, unit_id, analysis ORDER BY abs(d)) + (count(*) OVER (PARTITION BY session_id, unit_id, analysis, abs(d)) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY session_id, unit_id, analysis, abs(d)) AS t FROM d),
g AS (SELECT session_id, unit_id, analysis, count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS pl, sum(t * t - 1.0) AS ties FROM r GROUP BY 1, 2, 3), w AS (SELECT *, least(pl, n * (n + 1) / 2.0 - pl) AS w, n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0 AS var FROM g), z AS (SELECT *, (w - n * (n + 1) / 4.0) / sqrt(var) AS z FROM w)
SELECT session_id, unit_id, analysis, n, w, round(least(""" + special.erfc_sql("abs(z) / sqrt(2.0)") + ", 1), 6) AS p FROM z", "us sp tr")  # fmt: skip
def _(d: Data) -> DataFrame:
    c = response_counts(d).withColumn("d", F.col("post") - F.col("pre"))
    return stats.signed_rank(c, BY, "d").withColumn("p", F.round("p", 6))


_TM = _RANK + ", z AS (SELECT *, CASE WHEN k = 1 THEN 0.0 ELSE (r1 - n1 * (n1 + n0 + 1) / 2.0) / sqrt(n1 * n0 * (n1 + n0 + 1) / 12.0) END AS z FROM g), p AS (SELECT *, round(" + special.erfc_sql("abs(z) / sqrt(2.0)") + ", 9) AS p FROM z), q AS (SELECT *, p * count(*) OVER () / (count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM p), a AS (SELECT *, least(min(q) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS p_adj FROM q) "


@book("stat_fdr_bh", _TM + "SELECT session_id, unit_id, analysis, round(p_adj, 5) AS p_adj, p_adj <= 0.05 AS reject FROM a", "us sp tr")
@book("win_cummin_rev", _TM + "SELECT session_id, unit_id, analysis, round(p_adj, 5) AS p_adj, p_adj <= 0.05 AS reject FROM a", "us sp tr")
def _(d: Data) -> DataFrame:
    r = stats.rank_sum(two_classes(response_counts(d)), BY, "v", F.col("cls")).withColumn("p", F.round("p", 9))
    return stats.fdr(r, [], "p").select(*BY, F.round("p_adj", 5).alias("p_adj"), "reject")


@book("agg_task_mod", _TM + "SELECT session_id, unit_id, bool_or(p_adj <= 0.05) AS modulated, round(min(p_adj), 5) AS p_min FROM a GROUP BY 1, 2", "us sp tr")
def _(d: Data) -> DataFrame:
    r = stats.rank_sum(two_classes(response_counts(d)), BY, "v", F.col("cls")).withColumn("p", F.round("p", 9))
    return stats.fdr(r, [], "p").groupBy("session_id", "unit_id").agg(F.bool_or("reject").alias("modulated"), F.round(F.min("p_adj"), 5).alias("p_min"))


_BY_SQL = """WITH p AS (SELECT session_id, result_id, p_value FROM roc WHERE p_value IS NOT NULL AND session_id IS NOT NULL), m AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS m FROM p),
h AS (SELECT *, (SELECT sum(1.0 / i) FROM range(1, m.m + 1) t(i)) AS c FROM m), q AS (SELECT *, p_value * m * c / (count(*) OVER (PARTITION BY session_id ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM h)
SELECT result_id, round(least(min(q) OVER (PARTITION BY session_id ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 5) AS p_adj FROM q"""


@book("stat_fdr_by", _BY_SQL, "roc")
def _(d: Data) -> DataFrame:
    r = d.roc().where("p_value is not null and session_id is not null").select("session_id", "result_id", "p_value")
    return stats.fdr(r, ["session_id"], "p_value", "by").select("result_id", F.round("p_adj", 5).alias("p_adj"))


@book("cmp_fdr_bar", """WITH q AS (SELECT *, p_value * count(*) OVER () / (count(*) OVER (ORDER BY p_value RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM roc WHERE p_value IS NOT NULL), a AS (SELECT *, min(q) OVER (ORDER BY p_value DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS adj FROM q)
SELECT area_acronym_custom, count(DISTINCT CASE WHEN p_value <= 0.05 THEN (session_id, neuron_id) END) AS n_raw, count(DISTINCT CASE WHEN adj <= 0.05 THEN (session_id, neuron_id) END) AS n_fdr FROM a WHERE session_id IS NOT NULL AND neuron_id IS NOT NULL GROUP BY 1""", "roc")
def _(d: Data) -> DataFrame:
    a = stats.fdr(d.roc().where("p_value is not null"), [], "p_value").where("session_id is not null and neuron_id is not null")
    u = F.struct("session_id", "neuron_id")
    return a.groupBy(AREA).agg(F.count_distinct(F.when(F.col("p_value") <= 0.05, u)).alias("n_raw"), F.count_distinct(F.when(F.col("p_adj") <= 0.05, u)).alias("n_fdr"))


# ---- proportions and support


@book("agg_having_support", "SELECT area_acronym_custom, analysis_type, count(DISTINCT mouse_id) AS n_mice, count(*) AS n FROM roc WHERE area_acronym_custom IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10 AND count(DISTINCT mouse_id) >= 2", "roc")
def _(d: Data) -> DataFrame:
    g = d.roc().where(f"{AREA} is not null").groupBy(AREA, "analysis_type").agg(F.count_distinct("mouse_id").alias("n_mice"), F.count("*").alias("n"))
    return g.where("n >= 10 and n_mice >= 2")


@book("agg_shared_areas", "SELECT ccf_parent_acronym AS area FROM u WHERE ccf_parent_acronym IS NOT NULL GROUP BY 1 HAVING count(DISTINCT CASE WHEN reward_group = 0 THEN unit_id END) >= 3 AND count(DISTINCT CASE WHEN reward_group = 1 THEN unit_id END) >= 3", "u")
def _(d: Data) -> DataFrame:
    u = d.unit_rows("ccf_parent_acronym", "reward_group").withColumnRenamed("ccf_parent_acronym", "area")
    return rel.shared(u, "area", "reward_group", "unit_id", 3, [0, 1])


_PROP = """WITH base AS (SELECT {k}, area_acronym_custom AS area, analysis_type, significant, direction FROM roc WHERE {k} IS NOT NULL AND area_acronym_custom IS NOT NULL AND analysis_type IS NOT NULL),
g AS (SELECT {k}, area, analysis_type, count(*) AS n FROM base GROUP BY 1, 2, 3), dir AS (SELECT unnest(['positive', 'negative']) AS direction),
s AS (SELECT {k}, area, analysis_type, direction, count(*) AS c FROM base WHERE significant AND direction IN ('positive', 'negative') GROUP BY 1, 2, 3, 4)
SELECT g.{k}, g.area, g.analysis_type, dir.direction, round(100.0 * coalesce(s.c, 0) / g.n, 6) AS proportion, round(100.0 * sum(coalesce(s.c, 0)) OVER (PARTITION BY g.{k}, g.area, g.analysis_type) / g.n, 6) AS proportion_all
FROM g CROSS JOIN dir LEFT JOIN s ON s.{k} = g.{k} AND s.area = g.area AND s.analysis_type = g.analysis_type AND s.direction = dir.direction"""


def proportions(r: DataFrame, entity: str) -> DataFrame:
    """Percent significant per entity, area, analysis and direction, with zero rows; proportion_all over both directions."""
    keys = [entity, "area", "analysis_type"]
    b = r.withColumnRenamed(AREA, "area").where(" and ".join(f"{k} is not null" for k in keys))
    g = b.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.col("significant") & (F.col("direction") == x)).alias(x) for x in ("positive", "negative")])
    e = F.explode(F.array(*[F.struct(F.lit(x).alias("direction"), F.col(x).alias("c")) for x in ("positive", "negative")]))
    x = g.withColumn("_all", F.col("positive") + F.col("negative")).withColumn("e", e)
    return x.select(*keys, "e.direction", F.round(100.0 * F.col("e.c") / F.col("n"), 6).alias("proportion"), F.round(100.0 * F.col("_all") / F.col("n"), 6).alias("proportion_all"))


@book("agg_prop_sig", _PROP.format(k="mouse_id"), "roc")
def _(d: Data) -> DataFrame:
    return proportions(d.roc(), "mouse_id")


@book("agg_prop_sig_session", _PROP.format(k="session_id"), "roc")
def _(d: Data) -> DataFrame:
    return proportions(d.roc(), "session_id")


@book("agg_mean_sel", "SELECT mouse_id, area_acronym_custom, analysis_type, CAST(sum(CAST(abs(selectivity) AS DECIMAL(28, 8))) AS DOUBLE) / nullif(count(selectivity), 0) AS mean_sel FROM roc GROUP BY 1, 2, 3", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().groupBy("mouse_id", AREA, "analysis_type").agg(F.try_divide(F.sum(F.abs("selectivity").cast("decimal(28,8)")).cast("double"), F.count("selectivity")).alias("mean_sel"))


_DELTA = "WITH p AS (SELECT mouse_id, area_acronym_custom AS area, 100.0 * avg(CAST(significant AS INT)) FILTER (analysis_type = 'whisker_passive_pre') AS pre, 100.0 * avg(CAST(significant AS INT)) FILTER (analysis_type = 'whisker_passive_post') AS post FROM roc WHERE mouse_id IS NOT NULL AND area_acronym_custom IS NOT NULL GROUP BY 1, 2) "


def deltas(d: Data) -> DataFrame:
    r = d.roc().withColumnRenamed(AREA, "area").where("mouse_id is not null and area is not null")
    sig = lambda k: F.avg(F.when(F.col("analysis_type") == k, F.col("significant").cast("int") * 100.0))
    return r.groupBy("mouse_id", "area").agg(sig("whisker_passive_pre").alias("pre"), sig("whisker_passive_post").alias("post")).dropna(subset=["pre", "post"])


@book("agg_delta_pre_post", _DELTA + "SELECT mouse_id, area, round(post - pre, 5) AS delta FROM p WHERE pre IS NOT NULL AND post IS NOT NULL", "roc")
@book("cmp_delta_prop", _DELTA + "SELECT mouse_id, area, round(post - pre, 5) AS delta FROM p WHERE pre IS NOT NULL AND post IS NOT NULL", "roc")
def _(d: Data) -> DataFrame:
    return deltas(d).select("mouse_id", "area", F.round(F.col("post") - F.col("pre"), 5).alias("delta"))


@book("cmp_before_after", _DELTA + "SELECT mouse_id, area, 'pre' AS period, round(pre, 5) AS v FROM p WHERE pre IS NOT NULL UNION ALL SELECT mouse_id, area, 'post', round(post, 5) FROM p WHERE post IS NOT NULL", "roc")
def _(d: Data) -> DataFrame:
    r = d.roc().withColumnRenamed(AREA, "area").where("mouse_id is not null and area is not null")
    period = F.when(F.col("analysis_type") == "whisker_passive_pre", "pre").when(F.col("analysis_type") == "whisker_passive_post", "post")
    g = r.groupBy("mouse_id", "area", period.alias("period")).agg(F.round(F.avg(F.col("significant").cast("int") * 100.0), 5).alias("v"))
    return g.where("period is not null and v is not null")


_SI = """WITH s AS (SELECT session_id, neuron_id, avg(selectivity) FILTER (analysis_type = 'whisker_passive_pre') AS pre, avg(selectivity) FILTER (analysis_type = 'whisker_passive_post') AS post FROM roc WHERE neuron_id IS NOT NULL GROUP BY 1, 2)
SELECT session_id, neuron_id, round(CASE WHEN post >= 0 THEN post - pre ELSE pre - post END, 6) AS delta FROM s WHERE pre IS NOT NULL AND post IS NOT NULL"""


@book("agg_si_delta", _SI, "roc")
def _(d: Data) -> DataFrame:
    m = lambda k: F.avg(F.when(F.col("analysis_type") == k, F.col("selectivity")))
    s = d.roc().where("neuron_id is not null").groupBy("session_id", "neuron_id").agg(m("whisker_passive_pre").alias("pre"), m("whisker_passive_post").alias("post")).dropna(subset=["pre", "post"])
    return s.select("session_id", "neuron_id", F.round(F.when(F.col("post") >= 0, F.col("post") - F.col("pre")).otherwise(F.col("pre") - F.col("post")), 6).alias("delta"))


@book("agg_area_weights", """WITH a AS (SELECT mouse_id, area_acronym_custom AS area, count(*) AS n FROM roc WHERE area_acronym_custom IS NOT NULL AND mouse_id IS NOT NULL GROUP BY 1, 2), b AS (SELECT area, reward_group, avg(n) AS m FROM a JOIN (SELECT mouse_id, min(reward_group) AS reward_group FROM units GROUP BY 1) USING (mouse_id) GROUP BY 1, 2),
h AS (SELECT area, CASE WHEN count(*) < 2 THEN 0 ELSE count(*) / sum(1.0 / m) END AS h FROM b GROUP BY 1) SELECT area, round(h / nullif(sum(h) OVER (), 0), 6) AS weight FROM h""", "roc")
def _(d: Data) -> DataFrame:
    n = d.roc().withColumnRenamed(AREA, "area").where("area is not null and mouse_id is not null").groupBy("mouse_id", "area").agg(F.count("*").alias("n"))
    g = d.units.groupBy("mouse_id").agg(F.min("reward_group").alias("reward_group"))
    b = n.join(g, "mouse_id").groupBy("area", "reward_group").agg(F.avg("n").alias("m"))
    h = b.groupBy("area").agg(F.when(F.count("*") < 2, F.lit(0.0)).otherwise(stats.harmonic(F.col("m"))).alias("h"))
    return h.select("area", F.round(F.try_divide(F.col("h"), F.nullif(h.agg(F.sum("h")).scalar(), F.lit(0.0))), 6).alias("weight"))


_SHARE = "WITH s AS (SELECT analysis_type, area_acronym_custom AS area, avg(CAST(significant AS INT)) AS p FROM roc WHERE area_acronym_custom IS NOT NULL GROUP BY 1, 2) "


def area_shares(d: Data) -> DataFrame:
    return d.roc().where(f"{AREA} is not null").groupBy("analysis_type", F.col(AREA).alias("area")).agg(F.avg(F.col("significant").cast("int")).alias("p"))


@book("agg_focality", _SHARE + "SELECT analysis_type, round(sum(p * p) / nullif(sum(p) * sum(p), 0), 6) AS focality FROM s GROUP BY 1", "roc")
@book("cmp_focality", _SHARE + "SELECT analysis_type, round(sum(p * p) / nullif(sum(p) * sum(p), 0), 6) AS focality FROM s GROUP BY 1", "roc")
def _(d: Data) -> DataFrame:
    return stats.focality(area_shares(d), ["analysis_type"], "p").withColumn("focality", F.round("focality", 6))


@book("agg_gini", _SHARE + ", r AS (SELECT *, row_number() OVER (PARTITION BY analysis_type ORDER BY p, area) AS i, count(*) OVER (PARTITION BY analysis_type) AS n FROM s WHERE p IS NOT NULL) SELECT analysis_type, any_value(n) AS n, round(2 * sum(i * p) / (any_value(n) * nullif(sum(p), 0)) - (any_value(n) + 1.0) / any_value(n), 6) AS gini FROM r GROUP BY 1", "roc")
def _(d: Data) -> DataFrame:
    return stats.gini(area_shares(d), ["analysis_type"], "p").withColumn("gini", F.round("gini", 6))


@book("agg_roc_metrics", "SELECT area_acronym_custom, analysis_type, round(avg(CAST(significant AS INT)), 6) AS fraction, round(avg(selectivity), 9) AS mean_sel, round(avg(abs(selectivity)), 6) AS mean_abs, count(DISTINCT neuron_id) AS n_units, count(DISTINCT mouse_id) AS n_mice FROM roc GROUP BY 1, 2", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().groupBy(AREA, "analysis_type").agg(
        F.round(F.avg(F.col("significant").cast("int")), 6).alias("fraction"), F.round(F.avg("selectivity"), 9).alias("mean_sel"), F.round(F.avg(F.abs("selectivity")), 6).alias("mean_abs"), F.count_distinct("neuron_id").alias("n_units"), F.count_distinct("mouse_id").alias("n_mice"),
    )


_GLM = "WITH g AS (SELECT DISTINCT result_id, mouse_id, neuron_id, fold, git_version, model_name, test_score, CASE WHEN CAST(test_corr AS VARCHAR) = 'nan' THEN NULL ELSE test_corr END AS test_corr FROM glm_results WHERE neuron_id IS NOT NULL) "


@book("agg_glm_metrics", _GLM + "SELECT model_name, fold, round(avg(test_score), 6) AS score, round(avg(test_corr), 9) AS corr, count(DISTINCT (mouse_id, neuron_id)) AS n_units FROM g WHERE mouse_id IS NOT NULL GROUP BY 1, 2")
def _(d: Data) -> DataFrame:
    return glm(d).where("mouse_id is not null").groupBy("model_name", "fold").agg(F.round(F.avg("test_score"), 6).alias("score"), F.round(F.avg("test_corr"), 9).alias("corr"), F.count_distinct(F.struct("mouse_id", "neuron_id")).alias("n_units"))


@book("agg_pooled_frac", "SELECT area_acronym_custom, round(avg(CAST(significant AS INT)), 6) AS fraction, count(*) AS n, count(DISTINCT mouse_id) AS n_mice FROM roc WHERE analysis_type = 'whisker_active' GROUP BY 1", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().where("analysis_type = 'whisker_active'").groupBy(AREA).agg(F.round(F.avg(F.col("significant").cast("int")), 6).alias("fraction"), F.count("*").alias("n"), F.count_distinct("mouse_id").alias("n_mice"))


@book("agg_region_metric", "SELECT area_acronym_custom, round(avg(abs(selectivity)), 6) AS mean_abs, round(CASE WHEN avg(CAST(significant AS INT)) = 0 THEN -1 ELSE 100 * avg(CAST(significant AS INT)) END, 5) AS percent FROM roc WHERE analysis_type = 'auditory_active' GROUP BY 1", "roc")
def _(d: Data) -> DataFrame:
    f = F.avg(F.col("significant").cast("int"))
    return d.roc().where("analysis_type = 'auditory_active'").groupBy(AREA).agg(F.round(F.avg(F.abs("selectivity")), 6).alias("mean_abs"), F.round(F.when(f == 0, F.lit(-1.0)).otherwise(100 * f), 5).alias("percent"))


_MM = "WITH m AS (SELECT mouse_id, area_acronym_custom AS area, analysis_type, avg(CAST(significant AS INT)) AS f FROM roc WHERE mouse_id IS NOT NULL GROUP BY 1, 2, 3) "


def mouse_fractions(d: Data) -> DataFrame:
    return d.roc().where("mouse_id is not null").groupBy("mouse_id", F.col(AREA).alias("area"), "analysis_type").agg(F.avg(F.col("significant").cast("int")).alias("f"))


@book("agg_frac_mean_sem", _MM + "SELECT area, analysis_type, count(*) AS n, round(avg(f), 6) AS mean, round(stddev_samp(f) / sqrt(count(*)), 5) AS sem FROM m GROUP BY 1, 2", "roc")
def _(d: Data) -> DataFrame:
    return mouse_fractions(d).groupBy("area", "analysis_type").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("mean"), F.round(F.stddev_samp("f") / F.sqrt(F.count("*")), 5).alias("sem"))


@book("agg_mouse_means", _MM + "SELECT mouse_id, area, analysis_type, round(f, 6) AS f FROM m", "roc")
def _(d: Data) -> DataFrame:
    return mouse_fractions(d).withColumn("f", F.round("f", 6))


@book("agg_corr_sig_prop", "WITH t AS (SELECT reward_group, mouse_id, count(DISTINCT neuron_id) AS n, count(DISTINCT CASE WHEN p_value < 0.05 THEN neuron_id END) AS s FROM neuron_results WHERE neuron_id IS NOT NULL AND mouse_id IS NOT NULL GROUP BY 1, 2) SELECT reward_group, round(avg(1.0 * s / n), 6) AS proportion FROM t GROUP BY 1")
def _(d: Data) -> DataFrame:
    t = d.neuron_results.where("neuron_id is not null and mouse_id is not null").groupBy("reward_group", "mouse_id").agg(F.count_distinct("neuron_id").alias("n"), F.count_distinct(F.when(F.col("p_value") < 0.05, F.col("neuron_id"))).alias("s"))
    return t.groupBy("reward_group").agg(F.round(F.avg(F.col("s") / F.col("n")), 6).alias("proportion"))


_OV = "WITH f AS (SELECT session_id, neuron_id, analysis_type AS k, bool_or(significant) AS s FROM roc WHERE neuron_id IS NOT NULL AND session_id IS NOT NULL AND analysis_type IS NOT NULL GROUP BY 1, 2, 3) "


@book("agg_overlap_matrix", _OV + "SELECT a.k AS given, b.k AS other, round(avg(CAST(b.s AS INT)), 6) AS p, count(*) AS n FROM f a JOIN f b ON a.session_id = b.session_id AND a.neuron_id = b.neuron_id WHERE a.s GROUP BY 1, 2", "roc")
def _(d: Data) -> DataFrame:
    f = d.roc().where("neuron_id is not null and session_id is not null and analysis_type is not null").groupBy("session_id", "neuron_id", F.col("analysis_type").alias("k")).agg(F.bool_or("significant").alias("s"))
    # a unit has at most one row per analysis, so its pairs are bounded by the number of analyses
    a, b = f.where("s").withColumnRenamed("k", "given").drop("s"), f.withColumnRenamed("k", "other")
    return a.join(b, ["session_id", "neuron_id"]).groupBy("given", "other").agg(F.round(F.avg(F.col("s").cast("int")), 6).alias("p"), F.count("*").alias("n"))


@book("cmp_membership", _OV + "SELECT n_sig, count(*) AS n_units FROM (SELECT session_id, neuron_id, count(*) FILTER (s) AS n_sig FROM f GROUP BY 1, 2) GROUP BY 1", "roc")
def _(d: Data) -> DataFrame:
    f = d.roc().where("neuron_id is not null and session_id is not null and analysis_type is not null").groupBy("session_id", "neuron_id", "analysis_type").agg(F.bool_or("significant").alias("s"))
    return f.groupBy("session_id", "neuron_id").agg(F.count_if("s").alias("n_sig")).groupBy("n_sig").agg(F.count("*").alias("n_units"))


@book("agg_crosstab", "SELECT bc, round(100.0 * count(*) FILTER (reward_group = 0) / count(*), 6) AS g0, round(100.0 * count(*) FILTER (reward_group = 1) / count(*), 6) AS g1 FROM (SELECT lower(trim(bc_label)) AS bc, reward_group FROM u) GROUP BY 1", "u")
def _(d: Data) -> DataFrame:
    p = d.unit_rows("bc_label", "reward_group").groupBy(F.lower(F.trim("bc_label")).alias("bc")).pivot("reward_group", [0, 1]).count()
    a, b = F.coalesce("0", F.lit(0)), F.coalesce("1", F.lit(0))
    return p.select("bc", F.round(100.0 * a / (a + b), 6).alias("g0"), F.round(100.0 * b / (a + b), 6).alias("g1"))


@book("agg_sankey", "SELECT target_region, ccf_parent_acronym, count(*) AS n FROM u GROUP BY 1, 2", "u")
def _(d: Data) -> DataFrame:
    return d.unit_rows("target_region", "ccf_parent_acronym").groupBy("target_region", "ccf_parent_acronym").agg(F.count("*").alias("n"))


_NR = "WITH n AS (SELECT DISTINCT result_id, mouse_id, neuron_id, area, reward_group, p_value, z_score, CASE WHEN isnan(shift_magnitude) THEN NULL ELSE shift_magnitude END AS x FROM neuron_results) "


def shifts(d: Data) -> DataFrame:
    x = F.when(~F.isnan("shift_magnitude"), F.col("shift_magnitude"))
    return d.neuron_results.select("result_id", "mouse_id", "neuron_id", "area", "reward_group", "p_value", "z_score", x.alias("x")).distinct()


@book("agg_latency_cluster", _NR + "SELECT area, round(avg(x), 5) AS mean, round(stddev_samp(x) / sqrt(count(x)), 5) AS sem, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, count(x) AS n_valid, count(*) AS n FROM n GROUP BY 1")
def _(d: Data) -> DataFrame:
    q = lambda p: F.round(F.percentile("x", F.lit(p)), 6)
    return shifts(d).groupBy("area").agg(F.round(F.avg("x"), 5).alias("mean"), F.round(F.stddev_samp("x") / F.sqrt(F.count("x")), 5).alias("sem"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"), F.count("x").alias("n_valid"), F.count("*").alias("n"))


@book("agg_cluster_roc", "SELECT imec_id, analysis_type, round(100.0 * count(*) FILTER (significant) / count(*), 6) AS percent, round(1.0 * count(*) FILTER (significant AND direction = 'positive') / nullif(count(*) FILTER (significant), 0), 6) AS positive FROM roc JOIN (SELECT DISTINCT session_id, original_unit_id AS neuron_id, min(imec_id) AS imec_id FROM units WHERE original_unit_id IS NOT NULL GROUP BY 1, 2) USING (session_id, neuron_id) GROUP BY 1, 2", "roc")
def _(d: Data) -> DataFrame:
    u = d.units.where("original_unit_id is not null").groupBy("session_id", F.col("original_unit_id").alias("neuron_id")).agg(F.min("imec_id").alias("imec_id"))
    g = d.roc().join(u, ["session_id", "neuron_id"]).groupBy("imec_id", "analysis_type").agg(F.count("*").alias("n"), F.count_if("significant").alias("s"), F.count_if(F.col("significant") & (F.col("direction") == "positive")).alias("k"))
    return g.select("imec_id", "analysis_type", F.round(100.0 * F.col("s") / F.col("n"), 6).alias("percent"), F.round(F.try_divide(F.col("k").cast("double"), F.col("s").cast("double")), 6).alias("positive"))


_H = "(count(*) FILTER (trial_type = 'whisker_trial' AND lick_flag = 1) + 0.5) / (count(*) FILTER (trial_type = 'whisker_trial') + 1)"
_FA = "(count(*) FILTER (trial_type = 'no_stim_trial' AND lick_flag = 1) + 0.5) / (count(*) FILTER (trial_type = 'no_stim_trial') + 1)"


@book("agg_dprime", f"WITH r AS (SELECT session_id, {_H} AS h, {_FA} AS f FROM tr GROUP BY 1) SELECT session_id, round(h, 6) AS hit_rate, round(f, 6) AS fa_rate, round({special.norm_ppf_sql('h')} - {special.norm_ppf_sql('f')}, 5) AS dprime FROM r", "tr")
def _(d: Data) -> DataFrame:
    is_ = lambda k: F.col("trial_type") == k
    hit = F.col("lick_flag") == 1
    r = d.trial_rows().groupBy("session_id").agg(stats.corrected_rate(F.count_if(is_("whisker_trial") & hit), F.count_if(is_("whisker_trial"))).alias("h"), stats.corrected_rate(F.count_if(is_("no_stim_trial") & hit), F.count_if(is_("no_stim_trial"))).alias("f"))
    return r.select("session_id", F.round("h", 6).alias("hit_rate"), F.round("f", 6).alias("fa_rate"), F.round(special.norm_ppf(F.col("h")) - special.norm_ppf(F.col("f")), 5).alias("dprime"))


@book("agg_f_mk", "WITH c AS (SELECT mouse_id, lower(trim(bc_label)) AS k, count(*) AS n FROM u WHERE bc_label IS NOT NULL GROUP BY 1, 2), ks AS (SELECT DISTINCT k FROM c), ms AS (SELECT DISTINCT mouse_id FROM c) SELECT ms.mouse_id, ks.k, round(1.0 * coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY ms.mouse_id), 6) AS f FROM ms CROSS JOIN ks LEFT JOIN c ON c.mouse_id = ms.mouse_id AND c.k = ks.k", "u")
def _(d: Data) -> DataFrame:
    c = d.unit_rows("mouse_id", "bc_label").where("bc_label is not null").groupBy("mouse_id", F.lower(F.trim("bc_label")).alias("k")).agg(F.count("*").alias("n"))
    x = rel.fill_domain(c, rel.domain(c, ["mouse_id"], ["k"]), ["mouse_id", "k"], ["n"])
    return x.select("mouse_id", "k", F.round(F.col("n") / F.sum("n").over(W.partitionBy("mouse_id")), 6).alias("f"))


@book("agg_mode", "WITH c AS (SELECT session_id, ccf_parent_acronym AS area, count(*) AS n FROM u WHERE ccf_parent_acronym IS NOT NULL GROUP BY 1, 2) SELECT session_id, area, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, area) AS k FROM c) WHERE k = 1", "u")
def _(d: Data) -> DataFrame:
    c = d.unit_rows("ccf_parent_acronym").where("ccf_parent_acronym is not null").groupBy("session_id", F.col("ccf_parent_acronym").alias("area")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "area", "n"))
    return c.groupBy("session_id").agg(best.alias("b")).select("session_id", "b.area", "b.n")


@book("agg_coverage", "WITH s AS (SELECT session_id, unit_id, min(t_us) AS a, max(t_us) AS b FROM sp GROUP BY 1, 2) SELECT session_id, unit_id, round((b - a) / nullif(max(b) OVER (PARTITION BY session_id) - min(a) OVER (PARTITION BY session_id), 0), 6) AS coverage FROM s", "sp")
def _(d: Data) -> DataFrame:
    s = d.spikes().groupBy("session_id", "unit_id").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b"))
    w = W.partitionBy("session_id")
    return s.select("session_id", "unit_id", F.round(F.try_divide((F.col("b") - F.col("a")).cast("double"), (F.max("b").over(w) - F.min("a").over(w)).cast("double")), 6).alias("coverage"))


@book("agg_population_resp", _CNT + "SELECT session_id, event_id, round(avg(post - pre), 6) AS mean, round(quantile_cont(post - pre, 0.5), 6) AS median, CAST(sum(post - pre) AS BIGINT) AS total FROM c GROUP BY 1, 2", "us sp tr")
def _(d: Data) -> DataFrame:
    x = response_counts(d).withColumn("x", F.col("post") - F.col("pre"))
    return x.groupBy("session_id", "event_id").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("median"), F.sum("x").alias("total"))


@book("agg_count_distinct", "SELECT analysis_type, count(DISTINCT mouse_id) AS n_mice, count(DISTINCT session_id) AS n_sessions, count(DISTINCT area_acronym_custom) AS n_areas FROM roc GROUP BY 1", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().groupBy("analysis_type").agg(F.count_distinct("mouse_id").alias("n_mice"), F.count_distinct("session_id").alias("n_sessions"), F.count_distinct(AREA).alias("n_areas"))


# ---- tests on result tables


@book("stat_kruskal")
def _(d: Data) -> DataFrame:
    return stats.kruskal(shifts(d).withColumn("all", F.lit(1)), ["reward_group"], "area", "x")


@book("stat_t", _NR + "SELECT area, count(x) FILTER (reward_group = 1) AS n1, count(x) FILTER (reward_group = 0) AS n0, round((avg(x) FILTER (reward_group = 1) - avg(x) FILTER (reward_group = 0)) / sqrt(var_samp(x) FILTER (reward_group = 1) / count(x) FILTER (reward_group = 1) + var_samp(x) FILTER (reward_group = 0) / count(x) FILTER (reward_group = 0)), 5) AS t FROM n GROUP BY 1 HAVING count(x) FILTER (reward_group = 1) > 1 AND count(x) FILTER (reward_group = 0) > 1")
def _(d: Data) -> DataFrame:
    w = stats.welch(shifts(d), ["area"], "x", F.col("reward_group") == 1)
    return w.where("n1 > 1 and n0 > 1").select("area", "n1", "n0", F.round("t", 5).alias("t"))


@book("stat_t_p")
def _(d: Data) -> DataFrame:
    return stats.welch(shifts(d), ["area"], "x", F.col("reward_group") == 1)


@book("cmp_area_pvals")
def _(d: Data) -> DataFrame:
    x = deltas(d).withColumn("diff", F.col("post") - F.col("pre"))
    return stats.one_sample_t(x, ["area"], "diff")


_TWO = "WITH k AS (SELECT area_acronym_custom AS area, count(*) FILTER (significant AND analysis_type = 'whisker_active') AS k1, count(*) FILTER (analysis_type = 'whisker_active') AS n1, count(*) FILTER (significant AND analysis_type = 'auditory_active') AS k0, count(*) FILTER (analysis_type = 'auditory_active') AS n0 FROM roc GROUP BY 1), q AS (SELECT *, 1.0 * (k1 + k0) / (n1 + n0) AS pool FROM k WHERE n1 > 0 AND n0 > 0), z AS (SELECT *, CASE WHEN pool * (1 - pool) > 0 THEN (1.0 * k1 / n1 - 1.0 * k0 / n0) / sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n0)) END AS z FROM q) "


def tables(d: Data) -> DataFrame:
    is_ = lambda k: F.col("analysis_type") == k
    g = d.roc().groupBy(F.col(AREA).alias("area")).agg(F.count_if(F.col("significant") & is_("whisker_active")).alias("k1"), F.count_if(is_("whisker_active")).alias("n1"), F.count_if(F.col("significant") & is_("auditory_active")).alias("k0"), F.count_if(is_("auditory_active")).alias("n0"))
    return g.where("n1 > 0 and n0 > 0")


@book("stat_prop_z", _TWO + "SELECT area, round(z, 5) + 0.0 AS z, round(" + special.erfc_sql("abs(z) / sqrt(2.0)") + ", 6) AS p FROM z", "roc")
def _(d: Data) -> DataFrame:
    z, p = stats.two_proportions(F.col("k1"), F.col("n1"), F.col("k0"), F.col("n0"))
    return tables(d).select("area", (F.round(z, 5) + 0.0).alias("z"), F.round(p, 6).alias("p"))


@book("stat_fisher")
def _(d: Data) -> DataFrame:
    c = lambda x: F.col(x)
    return tables(d).select("area", "k1", "n1", "k0", "n0", stats.fisher_p(c("k1"), c("n1") - c("k1"), c("k0"), c("n0") - c("k0")).alias("p"))


@book("corr_pearson", _NR + "SELECT area, round(corr(x, z_score), 5) AS r FROM n WHERE x IS NOT NULL AND z_score IS NOT NULL GROUP BY 1 HAVING count(*) > 2")
def _(d: Data) -> DataFrame:
    both = shifts(d).where("x is not null and z_score is not null")
    return both.groupBy("area").agg(F.round(special.corr("x", "z_score"), 5).alias("r"), F.count("*").alias("n")).where("n > 2").drop("n")


_SPEAR = _NR + ", v AS (SELECT area, x, z_score FROM n WHERE x IS NOT NULL AND z_score IS NOT NULL), r AS (SELECT area, rank() OVER (PARTITION BY area ORDER BY x) + (count(*) OVER (PARTITION BY area, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY area ORDER BY z_score) + (count(*) OVER (PARTITION BY area, z_score) - 1) / 2.0 AS rz FROM v) "


def mid_rank(by: list[str], value: str):
    """The mean rank of equal values within a group."""
    return F.rank().over(W.partitionBy(*by).orderBy(value)) + (F.count("*").over(W.partitionBy(*by, value)) - 1) / 2.0


@book("corr_spearman", _SPEAR + "SELECT area, round(corr(rx, rz), 5) AS r FROM r GROUP BY 1 HAVING count(*) > 2")
def _(d: Data) -> DataFrame:
    v = shifts(d).where("x is not null and z_score is not null")
    r = v.select("area", mid_rank(["area"], "x").alias("rx"), mid_rank(["area"], "z_score").alias("rz"))
    return r.groupBy("area").agg(F.round(special.corr("rx", "rz"), 5).alias("r"), F.count("*").alias("n")).where("n > 2").drop("n")


@book("win_rank", _SPEAR + "SELECT area, rx, rz FROM r")
def _(d: Data) -> DataFrame:
    v = shifts(d).where("x is not null and z_score is not null")
    return v.select("area", mid_rank(["area"], "x").alias("rx"), mid_rank(["area"], "z_score").alias("rz"))


@book("corr_partial", _NR + ", c AS (SELECT area, corr(x, z_score) AS xy, corr(x, p_value) AS xz, corr(z_score, p_value) AS yz FROM n WHERE x IS NOT NULL AND z_score IS NOT NULL AND p_value IS NOT NULL GROUP BY 1 HAVING count(*) > 3) SELECT area, round(greatest(least((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 1), -1), 5) AS r FROM c")
def _(d: Data) -> DataFrame:
    v = shifts(d).dropna(subset=["x", "z_score", "p_value"])
    c = v.groupBy("area").agg(special.corr("x", "z_score").alias("xy"), special.corr("x", "p_value").alias("xz"), special.corr("z_score", "p_value").alias("yz"), F.count("*").alias("n")).where("n > 3")
    r = F.try_divide(F.col("xy") - F.col("xz") * F.col("yz"), F.nullif(F.sqrt((1 - F.col("xz") * F.col("xz")) * (1 - F.col("yz") * F.col("yz"))), F.lit(0.0)))
    return c.select("area", F.round(F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)), 5).alias("r"))


@book("cmp_si_grid", "WITH s AS (SELECT session_id, neuron_id, area_acronym_custom AS area, avg(selectivity) FILTER (analysis_type = 'whisker_active') AS a, avg(selectivity) FILTER (analysis_type = 'auditory_active') AS b FROM roc WHERE neuron_id IS NOT NULL GROUP BY 1, 2, 3) SELECT area, count(*) AS n, round(corr(a, b), 5) AS r FROM s WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1 HAVING count(*) > 2", "roc")
def _(d: Data) -> DataFrame:
    m = lambda k: F.avg(F.when(F.col("analysis_type") == k, F.col("selectivity")))
    s = d.roc().where("neuron_id is not null").groupBy("session_id", "neuron_id", F.col(AREA).alias("area")).agg(m("whisker_active").alias("a"), m("auditory_active").alias("b")).dropna(subset=["a", "b"])
    return s.groupBy("area").agg(F.count("*").alias("n"), F.round(special.corr("a", "b"), 5).alias("r")).where("n > 2")


@book("fit_ols", _NR + "SELECT area, count(*) AS n, round(regr_slope(x, z_score), 5) AS slope, round(regr_intercept(x, z_score), 5) AS intercept, round(regr_r2(x, z_score), 5) AS r2 FROM n WHERE x IS NOT NULL AND z_score IS NOT NULL GROUP BY 1 HAVING count(*) > 2")
@book("cmp_anatomy_pooled", _NR + "SELECT area, count(*) AS n, round(regr_slope(x, z_score), 5) AS slope, round(regr_intercept(x, z_score), 5) AS intercept, round(regr_r2(x, z_score), 5) AS r2 FROM n WHERE x IS NOT NULL AND z_score IS NOT NULL GROUP BY 1 HAVING count(*) > 2")
def _(d: Data) -> DataFrame:
    v = shifts(d).where("x is not null and z_score is not null")
    return v.groupBy("area").agg(F.count("*").alias("n"), F.round(F.regr_slope("x", "z_score"), 5).alias("slope"), F.round(F.regr_intercept("x", "z_score"), 5).alias("intercept"), F.round(F.regr_r2("x", "z_score"), 5).alias("r2")).where("n > 2")


@book("cmp_glm_resid", _GLM + ", c AS (SELECT mouse_id, neuron_id, round(corr(test_score, test_corr), 9) AS r FROM g WHERE test_corr IS NOT NULL AND test_score IS NOT NULL AND mouse_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 2) SELECT mouse_id, count(r) AS n, round(avg(r), 5) AS mean FROM c WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY 1")
def _(d: Data) -> DataFrame:
    c = glm(d).where("test_corr is not null and test_score is not null and mouse_id is not null").groupBy("mouse_id", "neuron_id").agg(special.corr("test_score", "test_corr").alias("r"), F.count("*").alias("k")).where("k > 2 and r is not null and not isnan(r)")
    return c.groupBy("mouse_id").agg(F.count("r").alias("n"), F.round(F.avg("r"), 5).alias("mean"))


QUERIES, ORACLE = book.queries, book.oracle
