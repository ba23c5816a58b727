"""Model fits, embeddings and clusters, unit quality."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.functions import labels
from axonlake.operators import encoding as enc, fit, hist, quality, relational as rel
from axonlake.operators.interval import micros
from axonlake.plans.correlation import mice
from axonlake.plans.registry import Book, Data
from axonlake.plans.statistics import response_counts, shifts

book = Book()
UNIT = ["session_id", "unit_id"]


@book("fit_aic3")
@book("cmp_inflection_session")
def _(d: Data) -> DataFrame:
    return fit.compare_models(response_counts(d), UNIT, "event_id", "post", 8)


@book("cmp_inflection_lag")
def _(d: Data) -> DataFrame:
    m = fit.compare_models(response_counts(d), UNIT, "event_id", "post", 8).where("best = 'sigmoid'")
    learning = d.neuron_results.groupBy("mouse_id").agg(F.min("inflection_trial").alias("learning_trial"))
    return m.join(d.unit_rows("mouse_id"), UNIT).join(learning, "mouse_id", "left").select(*UNIT, (F.col("learning_trial") - F.col("midpoint")).alias("lag"))


@book("fit_aic_linear", """WITH c AS (SELECT area, row_number() OVER (PARTITION BY area ORDER BY result_id) - 1 AS t, x FROM (SELECT DISTINCT result_id, area, CASE WHEN isnan(shift_magnitude) THEN NULL ELSE shift_magnitude END AS x FROM neuron_results) WHERE x IS NOT NULL)
SELECT area, count(*) AS n, round(count(*) * ln(regr_syy(x, t) / count(*)) + 4, 4) AS aic_constant, round(count(*) * ln(regr_syy(x, t) * (1 - regr_r2(x, t)) / count(*)) + 6, 4) AS aic_linear FROM c GROUP BY 1 HAVING count(*) >= 10""")
def _(d: Data) -> DataFrame:
    x = shifts(d).where("x is not null").withColumn("t", F.row_number().over(W.partitionBy("area").orderBy("result_id")) - 1)
    n = F.count("*")
    g = x.groupBy("area").agg(n.alias("n"), F.regr_syy("x", "t").alias("s"), F.regr_r2("x", "t").alias("r2")).where("n >= 10")
    return g.select("area", "n", F.round(F.col("n") * F.ln(F.col("s") / F.col("n")) + 4, 4).alias("aic_constant"), F.round(F.col("n") * F.ln(F.col("s") * (1 - F.col("r2")) / F.col("n")) + 6, 4).alias("aic_linear"))


# ---- encoding models over trials and bins

SCALARS = ["trial_index", "reward_available", "lick_before", "whisker_rewarded_before"]
SIGNALS = ["jaw_distance", "nose_distance", "pupil_area", "whisker_velocity"]
PREDICTORS = ["offset", *SCALARS, *enc.kernel_columns(enc.KERNELS), *SIGNALS]
GROUPS = ("whisker_stim", "auditory_stim", "jaw_onset", "lick_before", "whisker_rewarded", "trial_index")


def glm_trials(d: Data) -> DataFrame:
    """Active trials with their events' times and trial-level predictors."""
    t = d.trial_rows().where("ctx = 'active' and at_us is not null")
    w = W.partitionBy("session_id").orderBy("at_us", "trial_id")
    past = w.rowsBetween(W.unboundedPreceding, -1)
    rewarded = F.when(F.col("whisker_stim") == 1, (F.col("reward_available") * F.col("lick_flag")).cast("double"))
    size = F.count("*").over(W.partitionBy("session_id")) - 1
    return t.select(
        "session_id", "event_id", "at_us", "reward_available", rel.fold_of(F.col("trial_id"), 5).alias("fold"),
        F.when(F.col("whisker_stim") == 1, F.col("at_us")).alias("t_whisker"), F.when(F.col("auditory_stim") == 1, F.col("at_us")).alias("t_auditory"), micros(F.col("jaw_onset_time")).alias("t_jaw"),
        F.try_divide((F.row_number().over(w) - 1).cast("double"), F.nullif(size, F.lit(0))).alias("trial_index"),
        F.lag("lick_flag", 1).over(w).alias("lick_before"), F.last(rewarded, ignorenulls=True).over(past).alias("whisker_rewarded_before"),
    )


def glm_design(d: Data) -> DataFrame:
    t = glm_trials(d)
    fine = F.col("value").isNotNull() & ~F.isnan("value") & F.col("t").isNotNull()
    s = d.samples.where(fine).distinct().select("session_id", "signal", micros(F.col("t")).alias("t_us"), F.when(F.col("signal") == "whisker_velocity", F.abs("value")).otherwise(F.col("value")).alias("value"))
    x = enc.design_matrix(t, ["session_id"], "event_id", "at_us", {"whisker_stim": "t_whisker", "auditory_stim": "t_auditory", "jaw_onset": "t_jaw"}, SCALARS, samples=s, signals=SIGNALS)
    return x.join(t.select("session_id", "event_id", "fold"), ["session_id", "event_id"])


def glm_fits(d: Data, models: dict[str, list[str]], **kw) -> DataFrame:
    counts = enc.binned_counts(d.spikes(), glm_trials(d), ["session_id"], "unit_id", "event_id")
    return enc.fit_binned(glm_design(d), counts, d.unit_rows(), "session_id", "unit_id", "event_id", "fold", models, tuple(SIGNALS), **kw)


def _design_sql() -> str:
    """The design by plain CASE expressions over trials and bins."""
    own = "(t_{0} - at_us + 1000000) // 100000"
    times = {"whisker_stim": "whisker", "auditory_stim": "auditory", "jaw_onset": "jaw"}
    cols = []
    for name, (before, after) in enc.KERNELS.items():
        o = own.format(times[name])
        for s, c in zip(range(-before, after), enc.kernel_columns({name: (before, after)})):
            cols.append(f"CASE WHEN t_{times[name]} >= at_us - 1000000 AND {o} < 30 AND g.bin = {o} + {s} THEN 1.0 ELSE 0.0 END::DOUBLE AS {c}")
    value = "CASE WHEN signal = 'whisker_velocity' THEN abs(value) ELSE value END"
    means = ", ".join(f"round(coalesce(sb.{g}, 0), 6) AS {g}" for g in SIGNALS)
    per_bin = ", ".join(f"avg(v) FILTER (signal = '{g}') AS {g}" for g in SIGNALS)
    return (
        "WITH t AS (SELECT session_id, event_id, trial_id, at_us, reward_available, lick_flag, whisker_stim, CASE WHEN whisker_stim = 1 THEN at_us END AS t_whisker, CASE WHEN auditory_stim = 1 THEN at_us END AS t_auditory, CASE WHEN NOT isnan(jaw_onset_time) THEN CAST(round(jaw_onset_time * 1000000) AS BIGINT) END AS t_jaw FROM tr WHERE ctx = 'active' AND at_us IS NOT NULL), "
        "k AS (SELECT *, (row_number() OVER w - 1) / nullif(count(*) OVER (PARTITION BY session_id) - 1, 0) AS trial_index, lag(lick_flag) OVER w AS l1, last_value(CASE WHEN whisker_stim = 1 THEN reward_available * lick_flag END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY at_us, trial_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wr FROM t WINDOW w AS (PARTITION BY session_id ORDER BY at_us, trial_id)), "
        f"sm AS (SELECT s.session_id, event_id, signal, {value} AS v, (CAST(round(s.t * 1000000) AS BIGINT) - at_us + 1000000) // 100000 AS bin FROM (SELECT DISTINCT * FROM samples WHERE value IS NOT NULL AND NOT isnan(value) AND t IS NOT NULL) s JOIN t ON t.session_id = s.session_id AND CAST(round(s.t * 1000000) AS BIGINT) >= at_us - 1000000 AND CAST(round(s.t * 1000000) AS BIGINT) < at_us + 2000000), "
        f"sb AS (SELECT session_id, event_id, bin, {per_bin} FROM sm GROUP BY 1, 2, 3), g AS (SELECT *, CAST(unnest(range(0, 30)) AS INT) AS bin FROM k) "
        "SELECT g.session_id, g.event_id, g.bin, CAST(1.0 AS DOUBLE) AS \"offset\", round(coalesce(trial_index, 0), 6) AS trial_index, CAST(coalesce(reward_available, 0) AS DOUBLE) AS reward_available, CAST(coalesce(l1, 0) AS DOUBLE) AS lick_before, CAST(coalesce(wr, 0) AS DOUBLE) AS whisker_rewarded_before, "
        + ", ".join(cols) + f", {means}, ((trial_id * 7919 + 12345) % 1000003) % 5 AS fold FROM g LEFT JOIN sb ON sb.session_id = g.session_id AND sb.event_id = g.event_id AND sb.bin = g.bin"
    )


@book("fit_design", _design_sql(), "tr")
@book("cmp_glm_tensor", _design_sql(), "tr")
def _(d: Data) -> DataFrame:
    """The design of every session: trials x bins of 100 ms from -1 to 2 s, kernels, analog bin means and scalars."""
    return glm_design(d).withColumns({c: F.round(c, 6) for c in ("trial_index", *SIGNALS)})


@book("fit_ridge")
def _(d: Data) -> DataFrame:
    return glm_fits(d, {"full": PREDICTORS}).withColumn("coef", F.to_json("coef")).withColumn("predictors", F.array_join("predictors", ","))


@book("fit_nested")
def _(d: Data) -> DataFrame:
    """The full model, one without each group of predictors, one with jaw kernels and signals added to the stimuli alone, all at the
    full model's penalty."""
    stimuli = [c for c in PREDICTORS if c.startswith(("offset", "whisker_stim", "auditory_stim"))]
    models = {"full": PREDICTORS, **enc.groups_of(PREDICTORS, GROUPS), "stimuli": stimuli, "stimuli_and_movement": [*stimuli, *[c for c in PREDICTORS if c.startswith("jaw_onset")], *SIGNALS]}
    return glm_fits(d, models).select(*UNIT, "fold", "model_name", "lambda_opt", "train_score", "test_score")


@book("cmp_glm_io")
def _(d: Data) -> DataFrame:
    """Fits saved under a version and read back."""
    from axonlake.session import scratch_dir

    path = scratch_dir(d.spark, "fits")
    version = "v1"
    glm_fits(d, {"full": PREDICTORS}).withColumn("version", F.lit(version)).write.partitionBy("version").parquet(path)
    return d.spark.read.parquet(path).where(F.col("version") == version).select(*UNIT, "fold", "model_name", F.size("coef").alias("n_coef"), "test_score", "version")


@book("fit_mi")
def _(d: Data) -> DataFrame:
    """Bits per spike of the full model against a constant rate."""
    return glm_fits(d, {"full": PREDICTORS}).select(*UNIT, "fold", "train_mi", "test_mi")


FEATURES = ["whisker_stim", "auditory_stim", "lick_flag", "reward_available"]


def design(d: Data) -> DataFrame:
    """Trials of each unit with stimulus, outcome and lagged columns and the response."""
    t = d.trial_rows().where("ctx = 'active' and trial_type <> 'no_stim_trial'")
    w = W.partitionBy("session_id").orderBy("at_us", "trial_id")
    t = t.select("session_id", "event_id", *[F.col(f).cast("double").alias(f) for f in FEATURES], F.coalesce(F.lag("lick_flag", 1).over(w), F.lit(0)).cast("double").alias("lick_lag1"), rel.fold_of(F.col("trial_id"), 3).alias("fold"))
    return response_counts(d).select("session_id", "unit_id", "event_id", "post").join(t, ["session_id", "event_id"])


@book("fit_poisson")
def _(d: Data) -> DataFrame:
    cols = [*FEATURES, "lick_lag1"]
    return fit.fit_units(design(d), UNIT, "post", cols, "fold", "poisson", {"full": cols}).select(*UNIT, "fold", "train_score", "test_score", "test_corr")


@book("cmp_mask_bins")
def _(d: Data) -> DataFrame:
    """What the whisker kernel explains in one bin alone: the full model against models that keep it in that bin only."""
    models = {"full": PREDICTORS, **{f"bin_{b}": PREDICTORS for b in (10, 11, 12)}}
    masks = {f"bin_{b}": {c: (b,) for c in PREDICTORS if c.startswith("whisker_stim")} for b in (10, 11, 12)}
    return glm_fits(d, models, masks=masks).select(*UNIT, "fold", "model_name", "test_score")


# ---- densities and clusters


@book("fit_gmm")
@book("cmp_waveform_old")
def _(d: Data) -> DataFrame:
    return fit.mixture_threshold(d.unit_rows("reward_group", "waveformDuration_peakTrough"), ["reward_group"], "waveformDuration_peakTrough")


_GRID = [-5.0, 0.0, 2.5, 5.0, 10.0]


@book("fit_kde", "WITH n AS (SELECT DISTINCT result_id, area, CASE WHEN isnan(shift_magnitude) THEN NULL ELSE shift_magnitude END AS x FROM neuron_results), v AS (SELECT area, x, count(*) OVER g AS n, stddev_samp(x) OVER g * pow(count(*) OVER g, -0.2) AS h FROM n WHERE x IS NOT NULL WINDOW g AS (PARTITION BY area)), k AS (SELECT unnest([-5.0, 0.0, 2.5, 5.0, 10.0]::DOUBLE[]) AS gx) SELECT area, gx AS x, round(sum(exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / max(n * h * 2.5066282746310002), 6) AS density FROM v, k WHERE h > 0 GROUP BY 1, 2")
def _(d: Data) -> DataFrame:
    return fit.kde(shifts(d), ["area"], "x", _GRID).withColumn("density", F.round("density", 6))


def embedding_vectors(d: Data) -> DataFrame:
    return fit.vectors(d.embeddings.select("vec_id", "embedding", "label"), "embedding")


@book("fit_kmeans")
def _(d: Data) -> DataFrame:
    rows, _cost = fit.kmeans(embedding_vectors(d), 8)
    return rows.select("vec_id", "cluster")


@book("fit_pca")
def _(d: Data) -> DataFrame:
    v = fit.pca_variance(embedding_vectors(d), 10)
    return d.spark.createDataFrame([(i + 1, x) for i, x in enumerate(v)], "component int, explained double")


@book("fit_rastermap")
def _(d: Data) -> DataFrame:
    """Units ordered along the first principal component: the stated substitute for an external one-dimensional embedding."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    v = embedding_vectors(d)
    p = PCA(k=1, inputCol="features", outputCol="pc").fit(v).transform(v).select("vec_id", vector_to_array("pc")[0].alias("pc1"))
    return p.orderBy("pc1", "vec_id")


@book("fit_linkage")
def _(d: Data) -> DataFrame:
    """Meta clusters of the ten label means (a bounded table) by average linkage on 1 - r."""
    e = d.embeddings.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    m = e.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("m")).limit(5001).toPandas().sort_values("label")
    if len(m) > 5000:
        raise ValueError("meta clusters are for a bounded number of cluster means")
    k = fit.linkage_labels(np.array(m["m"].tolist()), 4)
    return d.spark.createDataFrame(list(zip([int(x) for x in m["label"]], [int(x) for x in k])), "label int, meta int")


_CT = "WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v, vec_id FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM c GROUP BY 1, 2) SELECT c.vec_id, round(sum(c.v * m.m) / sqrt(sum(c.v * c.v) * sum(m.m * m.m)), 4) AS cos FROM c JOIN m ON m.label = c.label AND m.i = c.i GROUP BY 1"


@book("fit_cv_similarity", _CT)
def _(d: Data) -> DataFrame:
    e = d.embeddings
    m = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    means = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    return e.join(means, "label").select("vec_id", F.round(fit.cosine(F.col("embedding"), F.col("mean")), 4).alias("cos"))


@book("fit_lz76")
def _(d: Data) -> DataFrame:
    """Complexity of each unit's sequence of trials with and without response spikes."""
    s = response_counts(d).groupBy(*UNIT).agg(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("post") > 0, "1").otherwise("0").alias("b")))).alias("s"))
    bits = F.array_join(F.transform("s", lambda x: x["b"]), "")
    udf = F.pandas_udf(lambda x: x.map(fit.lz76), "int")
    return s.select(*UNIT, udf(bits).alias("complexity"))


# ---- unit quality and the noise classifier


def unit_table(d: Data) -> DataFrame:
    return quality.unit_features(d.unit_rows("waveform_mean", "presenceRatio", "depth", "bc_label", "mouse_id"), d.spikes(), UNIT)


@book("agg_quality")
def _(d: Data) -> DataFrame:
    return quality.score_units(unit_table(d), UNIT)


_QSQL = """WITH i AS (SELECT session_id, unit_id, t_us, CAST(t_us - lag(t_us) OVER (PARTITION BY session_id, unit_id ORDER BY t_us) AS DOUBLE) AS isi FROM sp)
SELECT session_id, unit_id, count(*) AS n_spikes, round(avg(CAST(isi < 2000 AS INT)), 6) AS isi_violation, round(stddev_pop(isi) / nullif(avg(isi), 0), 5) AS isi_cv, round(avg(CAST(isi > 1000000 AS INT)), 6) AS isi_long, round(avg(CAST(isi < 10000 AS INT)), 6) AS burst_index FROM i GROUP BY 1, 2"""


@book("scl_unit_metrics", _QSQL, "sp")
def _(d: Data) -> DataFrame:
    q = unit_table(d).where("n_spikes > 0")
    return q.select(*UNIT, "n_spikes", *[F.round(c, 5 if c == "isi_cv" else 6).alias(c) for c in ("isi_violation", "isi_cv", "isi_long", "burst_index")])


NUMERIC = ["n_spikes", "isi_violation", "isi_cv", "isi_long", "burst_index", "wf_amplitude", "wf_width", "presenceRatio", "depth"]


@book("fit_rf")
@book("fit_predict")
def _(d: Data) -> DataFrame:
    """Noise or not, trained on every second mouse, the first among them, and applied to all: unit, probability, verdict."""
    from pyspark.ml.functions import vector_to_array

    x = unit_table(d).withColumns({c: F.col(c).cast("double") for c in NUMERIC}).where("bc_label is not null")
    x = x.withColumn("y", (F.lower(F.trim("bc_label")) == "noise").cast("double")).join(mice(d).select("mouse_id", (F.col("mouse") % 2 == 1).alias("even")), "mouse_id")
    share = x.where("even").agg(F.avg("y")).first()[0] or 0.5  # one number
    train = x.where("even").withColumn("wt", F.when(F.col("y") == 1, F.lit(0.5 / max(share, 1e-3))).otherwise(F.lit(0.5 / max(1 - share, 1e-3))))
    m = fit.forest(train, NUMERIC, "y", "wt", 20)
    return m.transform(x).select(*UNIT, vector_to_array("probability")[1].alias("p_noise"), (F.col("prediction") == 1).alias("is_noise"))


@book("cmp_features", "SELECT column_name AS feature FROM (DESCRIBE SELECT * FROM units) WHERE column_type IN ('DOUBLE', 'FLOAT', 'INTEGER', 'BIGINT') AND column_name NOT IN ('unit_id', 'neuron_id', 'original_unit_id', 'cluster_id', 'day', 'reward_group', 'imec_id')")
def _(d: Data) -> DataFrame:
    """The numeric columns of the unit table that are no keys."""
    keys = {"unit_id", "neuron_id", "original_unit_id", "cluster_id", "day", "reward_group", "imec_id"}
    names = [f.name for f in d.units.schema if f.dataType.typeName() in ("double", "float", "integer", "long") and f.name not in keys]
    return d.spark.createDataFrame([(n,) for n in names], "feature string")


@book("cmp_neuron_vector")
def _(d: Data) -> DataFrame:
    """Concatenated condition histograms per unit: signed square root of the baseline-subtracted rate, z-scored over the whole vector."""
    from axonlake.plans.spikes import _mean

    p = _mean(d, ["trial_type"])
    b = hist.subtract_baseline(p, [*UNIT, "trial_type"], "rate", 2)
    z = hist.zscore(b.withColumn("v", F.signum("value") * F.sqrt(F.abs("value"))), UNIT, "v")
    return z.groupBy(*UNIT).agg(F.transform(F.array_sort(F.collect_list(F.struct("trial_type", "bin", "z"))), lambda x: x["z"]).alias("vector")).withColumn("vector", F.to_json("vector"))


@book("cmp_oddness")
def _(d: Data) -> DataFrame:
    return d.unit_rows("waveform_mean").where("waveform_mean is not null and size(waveform_mean) > 1").select(*UNIT, labels.oddness(F.col("waveform_mean")).alias("score"))


QUERIES, ORACLE = book.queries, book.oracle
