"""Scalar, string, array and JSON functions; sources, sinks and streams."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from axonlake import sources, streaming
from axonlake.functions import labels, special
from axonlake.operators import fit, hist
from axonlake.plans.registry import Book, Data
from axonlake.plans.spikes import _fold_sql
from axonlake.plans.statistics import glm
from axonlake.session import scratch_dir
from axonlake.sources import arrays

book = Book()

_LAYER = "CASE WHEN regexp_matches(a, '^CA[123]$') THEN NULL ELSE nullif(regexp_extract(a, '[a-zA-Z](1|2/3|2|4|5|6a|6b|6)$', 1), '') END"


@book("scl_layer", f"WITH s AS (SELECT session_id, unit_id, ccf_acronym AS a FROM u), l AS (SELECT *, {_LAYER} AS layer FROM s) SELECT session_id, unit_id, layer, TRY_CAST(substr(layer, 1, 1) AS INT) AS layer_number, CASE WHEN layer IS NULL THEN a ELSE left(a, length(a) - length(layer)) END AS base, CASE WHEN layer IS NULL THEN 'none' WHEN CAST(substr(layer, 1, 1) AS INT) <= 3 THEN 'superficial' WHEN substr(layer, 1, 1) = '4' THEN 'granular' ELSE 'deep' END AS layer_group FROM l", "u")
@book("cmp_area_dims", f"WITH s AS (SELECT session_id, unit_id, ccf_acronym AS a FROM u), l AS (SELECT *, {_LAYER} AS layer FROM s) SELECT session_id, unit_id, layer, TRY_CAST(substr(layer, 1, 1) AS INT) AS layer_number, CASE WHEN layer IS NULL THEN a ELSE left(a, length(a) - length(layer)) END AS base, CASE WHEN layer IS NULL THEN 'none' WHEN CAST(substr(layer, 1, 1) AS INT) <= 3 THEN 'superficial' WHEN substr(layer, 1, 1) = '4' THEN 'granular' ELSE 'deep' END AS layer_group FROM l", "u")
def _(d: Data) -> DataFrame:
    a = F.col("ccf_acronym")
    return d.unit_rows("ccf_acronym").select("session_id", "unit_id", labels.layer(a).alias("layer"), labels.layer_number(a).alias("layer_number"), labels.without_layer(a).alias("base"), labels.layer_group(a).alias("layer_group"))


@book("scl_simplify", "SELECT DISTINCT ccf_parent_acronym AS area, CASE ccf_parent_acronym " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.SIMPLE.items()) + " ELSE ccf_parent_acronym END AS simple FROM units WHERE ccf_parent_acronym IS NOT NULL")
@book("cmp_swanson", "SELECT DISTINCT ccf_parent_acronym AS area, CASE ccf_parent_acronym " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.SIMPLE.items()) + " ELSE ccf_parent_acronym END AS simple FROM units WHERE ccf_parent_acronym IS NOT NULL")
def _(d: Data) -> DataFrame:
    return d.units.where("ccf_parent_acronym is not null").select(F.col("ccf_parent_acronym").alias("area"), labels.simplify(F.col("ccf_parent_acronym")).alias("simple")).distinct()


@book("cmp_imec", "SELECT session_id, unit_id, TRY_CAST(regexp_extract(electrode_group, 'imec(\\d+)', 1) AS INT) AS imec FROM u", "u")
def _(d: Data) -> DataFrame:
    return d.unit_rows("electrode_group").select("session_id", "unit_id", labels.probe_number(F.col("electrode_group")).alias("imec"))


@book("scl_location", "SELECT DISTINCT unit_id, element_at(location, 'area')[1] AS area, element_at(location, 'hemisphere')[1] AS hemisphere FROM units WHERE location IS NOT NULL")
@book("cmp_electrode", "SELECT DISTINCT unit_id, element_at(location, 'area')[1] AS area, element_at(location, 'hemisphere')[1] AS hemisphere FROM units WHERE location IS NOT NULL")
def _(d: Data) -> DataFrame:
    """The map read back from its dictionary-literal text."""
    text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries("location"), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"])), ", "), F.lit("}"))
    m = labels.location_map(text)
    return d.units.where("location is not null").select("unit_id", m["area"].alias("area"), m["hemisphere"].alias("hemisphere")).distinct()


@book("scl_parse_array", "SELECT DISTINCT unit_id, len(waveform_mean) AS n, round(list_sum(waveform_mean), 6) + 0.0 AS total FROM units WHERE waveform_mean IS NOT NULL")
def _(d: Data) -> DataFrame:
    text = F.concat(F.lit("["), F.array_join(F.transform("waveform_mean", lambda x: x.cast("string")), "  "), F.lit("]"))
    p = labels.parse_numbers(text)
    return d.units.where("waveform_mean is not null").select("unit_id", F.size(p).alias("n"), (F.round(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total")).distinct()


@book("scl_json", "SELECT DISTINCT result_id, len(coef) AS n, round(list_sum(coef), 6) + 0.0 AS total FROM glm_results WHERE coef IS NOT NULL")
def _(d: Data) -> DataFrame:
    back = F.from_json(F.to_json("coef"), "array<double>")
    return d.glm_results.where("coef is not null").select("result_id", F.size(back).alias("n"), (F.round(F.aggregate(back, F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total")).distinct()


@book("scl_math", "SELECT session_id, unit_id, round(sqrt(ccf_ap * ccf_ap + ccf_ml * ccf_ml), 4) AS radius, round(ln(abs(ccf_dv) + 1), 6) AS log_dv, sign(ccf_ml - 5700) AS side, round(least(greatest(ccf_ap / 10000, 0), 1), 6) AS clipped FROM u WHERE ccf_ap IS NOT NULL AND ccf_ml IS NOT NULL AND ccf_dv IS NOT NULL", "u")
def _(d: Data) -> DataFrame:
    u = d.unit_rows("ccf_ap", "ccf_ml", "ccf_dv").dropna()
    return u.select("session_id", "unit_id", F.round(F.hypot("ccf_ap", "ccf_ml"), 4).alias("radius"), F.round(F.ln(F.abs("ccf_dv") + 1), 6).alias("log_dv"), F.signum(F.col("ccf_ml") - 5700).cast("int").alias("side"), F.round(F.least(F.greatest(F.col("ccf_ap") / 10000, F.lit(0.0)), F.lit(1.0)), 6).alias("clipped"))


@book("scl_bregma", "SELECT session_id, unit_id, round(CASE WHEN mouse_id = 'QX00001' THEN ccf_ml - 5700 ELSE 5400 - ccf_ap END, 4) AS ap, round(CASE WHEN mouse_id = 'QX00001' THEN 5400 - ccf_ap ELSE ccf_ml - 5700 END, 4) AS ml, round(ccf_dv - 332, 4) AS dv FROM u", "u")
def _(d: Data) -> DataFrame:
    u = d.unit_rows("mouse_id", "ccf_ap", "ccf_ml", "ccf_dv")
    b = labels.bregma(F.col("ccf_ap"), F.col("ccf_ml"), F.col("ccf_dv"), F.col("mouse_id") == "QX00001")
    return u.select("session_id", "unit_id", *[F.round(c, 4).alias(n) for c, n in zip(b, ("ap", "ml", "dv"))])


@book("scl_cosines", "SELECT session_id, unit_id, round(cos(radians(depth / 100)) * cos(radians(imec_id * 45)), 6) + 0.0 AS x, round(cos(radians(depth / 100)) * sin(radians(imec_id * 45)), 6) + 0.0 AS y, round(sin(radians(depth / 100)), 6) + 0.0 AS z FROM u", "u")
def _(d: Data) -> DataFrame:
    u = d.unit_rows("depth", "imec_id")
    c = labels.direction_cosines(F.col("imec_id") * 45.0, F.col("depth") / 100)
    return u.select("session_id", "unit_id", *[(F.round(v, 6) + 0.0).alias(n) for v, n in zip(c, "xyz")])


_BOX = [("anterior", 0, 5000, 0, 11400, 0, 8000), ("lateral", 5000, 13200, 0, 3000, 0, 8000), ("dorsal", 5000, 13200, 3000, 11400, 0, 2000)]


@book("scl_boxes", "SELECT session_id, unit_id, CASE " + " ".join(f"WHEN ccf_ap BETWEEN {b[1]} AND {b[2]} AND ccf_ml BETWEEN {b[3]} AND {b[4]} AND ccf_dv BETWEEN {b[5]} AND {b[6]} THEN '{b[0]}'" for b in _BOX) + " ELSE 'outside' END AS part FROM u", "u")
def _(d: Data) -> DataFrame:
    return d.unit_rows("ccf_ap", "ccf_ml", "ccf_dv").select("session_id", "unit_id", labels.first_box(F.col("ccf_ap"), F.col("ccf_ml"), F.col("ccf_dv"), _BOX).alias("part"))


@book("scl_cell_type", "SELECT session_id, unit_id, CASE WHEN waveformDuration_peakTrough IS NULL OR CAST(waveformDuration_peakTrough AS VARCHAR) = 'nan' THEN NULL WHEN ccf_parent_acronym IN ('CP', 'ACB', 'OT') THEN CASE WHEN waveformDuration_peakTrough < 400 THEN 'interneuron' ELSE 'projection' END ELSE CASE WHEN waveformDuration_peakTrough < 400 THEN 'fsu' ELSE 'rsu' END END AS cell FROM u", "u")
def _(d: Data) -> DataFrame:
    return d.unit_rows("waveformDuration_peakTrough", "ccf_parent_acronym").select("session_id", "unit_id", labels.cell_type(F.col("waveformDuration_peakTrough"), F.col("ccf_parent_acronym")).alias("cell"))


@book("scl_waveform", "WITH w AS (SELECT DISTINCT unit_id, waveform_mean AS w FROM units WHERE waveform_mean IS NOT NULL), a AS (SELECT *, list_position(w, list_min(w)) AS p FROM w) SELECT unit_id, CAST(p - 1 AS INT) AS trough_at, round(list_min(w), 6) + 0.0 AS trough, round(list_max(w[p:]), 6) + 0.0 AS peak, CAST(list_position(w[p:], list_max(w[p:])) - 1 AS INT) AS width FROM a")
def _(d: Data) -> DataFrame:
    s = labels.waveform_stats(F.col("waveform_mean"))
    u = d.units.where("waveform_mean is not null and size(waveform_mean) > 1").select("unit_id", "waveform_mean").distinct()
    return u.select("unit_id", s["trough_at"].cast("int").alias("trough_at"), (F.round(s["trough"], 6) + 0.0).alias("trough"), (F.round(s["peak"], 6) + 0.0).alias("peak"), s["width"].cast("int").alias("width"))


@book("scl_strings", "SELECT result_id, contains(analysis_type, 'passive') AS passive, starts_with(analysis_type, 'whisker') AS whisker, lower(area_acronym_custom) AS area, substr(analysis_type, 1, 4) AS head, concat_ws('-', mouse_id, CAST(neuron_id AS VARCHAR)) AS key, regexp_matches(area_acronym_custom, '\\d') AS has_digit FROM roc", "roc")
def _(d: Data) -> DataFrame:
    a, area = F.col("analysis_type"), F.col("area_acronym_custom")
    return d.roc().select("result_id", a.contains("passive").alias("passive"), a.startswith("whisker").alias("whisker"), F.lower(area).alias("area"), F.substring(a, 1, 4).alias("head"), F.concat_ws("-", "mouse_id", F.col("neuron_id").cast("string")).alias("key"), area.rlike(r"\d").alias("has_digit"))


@book("scl_norm", "SELECT result_id, round(" + special.erfc_sql("-z / sqrt(2.0)") + " / 2, 6) AS cdf, round(" + special.norm_ppf_sql("q") + ", 5) + 0.0 AS ppf FROM (SELECT DISTINCT result_id, z_score AS z, least(greatest(p_value, 0.001), 0.999) AS q FROM neuron_results WHERE z_score IS NOT NULL AND p_value IS NOT NULL)")
def _(d: Data) -> DataFrame:
    n = d.neuron_results.where("z_score is not null and p_value is not null").select("result_id", "z_score", F.least(F.greatest("p_value", F.lit(0.001)), F.lit(0.999)).alias("q")).distinct()
    return n.select("result_id", F.round(special.norm_cdf(F.col("z_score")), 6).alias("cdf"), (F.round(special.norm_ppf(F.col("q")), 5) + 0.0).alias("ppf"))


@book("scl_size_map", "SELECT result_id, round(least(-log10(greatest(p_value, 1e-6)) / 6, 1), 6) + 0.0 AS size FROM roc WHERE p_value IS NOT NULL", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().where("p_value is not null").select("result_id", (F.round(F.least(-F.log10(F.greatest("p_value", F.lit(1e-6))) / 6, F.lit(1.0)), 6) + 0.0).alias("size"))


_INT = """WITH s AS (SELECT DISTINCT sample_id, session_id, signal, t, CASE WHEN isnan(value) THEN NULL ELSE value END AS v FROM samples), w AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER b AS t0, last_value(v IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER f AS t1, first_value(v IGNORE NULLS) OVER f AS v1 FROM s
WINDOW b AS (PARTITION BY session_id, signal ORDER BY t, sample_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY session_id, signal ORDER BY t, sample_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT sample_id, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL OR v1 IS NULL THEN coalesce(v0, v1) ELSE v0 + (v1 - v0) * (t - t0) / nullif(t1 - t0, 0) END, 5) + 0.0 AS v FROM w WHERE v IS NULL"""


@book("scl_interpolate", _INT)
def _(d: Data) -> DataFrame:
    """Missing values between neighbours filled on a straight line, beyond the ends by the nearest."""
    s = d.samples.distinct().withColumn("v", F.when(~F.isnan("value"), F.col("value")))
    # both windows run from an unbounded start: one to an unbounded end reads the rest of its rows anew for every row
    g = W.partitionBy("session_id", "signal")
    back, fore = (g.orderBy(*o).rowsBetween(W.unboundedPreceding, 0) for o in (("t", "sample_id"), (F.desc("t"), F.desc("sample_id"))))
    known = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    x = s.withColumn("a", F.last(known, ignorenulls=True).over(back)).withColumn("b", F.last(known, ignorenulls=True).over(fore)).where("v is null")
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("t") - F.col("a.t")) / F.nullif(F.col("b.t") - F.col("a.t"), F.lit(0.0))
    return x.select("sample_id", (F.round(F.when(F.col("a").isNull() | F.col("b").isNull(), F.coalesce("a.v", "b.v")).otherwise(line), 5) + 0.0).alias("v"))


@book("scl_outliers", "WITH s AS (SELECT DISTINCT sample_id, session_id, signal, value AS v FROM samples WHERE value IS NOT NULL AND NOT isnan(value)) SELECT sample_id FROM (SELECT *, avg(v) OVER g AS m, stddev_pop(v) OVER g AS sd FROM s WINDOW g AS (PARTITION BY session_id, signal)) WHERE sd > 0 AND abs(v - m) > 5 * sd")
def _(d: Data) -> DataFrame:
    s = d.samples.distinct().where("value is not null and not isnan(value)").withColumnRenamed("value", "v")
    z = hist.zscore(s, ["session_id", "signal"], "v")
    return z.where(F.abs("z") > 5).select("sample_id")


@book("cmp_neuronal_df", "SELECT DISTINCT result_id, round(post_response - pre_response, 6) + 0.0 AS evoked FROM neuron_results")
def _(d: Data) -> DataFrame:
    z = F.zip_with(F.array("post_response"), F.array("pre_response"), lambda a, b: a - b)
    return d.neuron_results.select("result_id", (F.round(z[0], 6) + 0.0).alias("evoked")).distinct()


@book("cmp_unit_lookup", "SELECT session_id, unit_id, max(t_us) AS last_us, any_value(stop) AS t_stop FROM sp, (SELECT max(t_us) AS stop FROM sp) GROUP BY 1, 2", "sp")
def _(d: Data) -> DataFrame:
    s = d.spikes()
    return s.groupBy("session_id", "unit_id").agg(F.max("t_us").alias("last_us")).withColumn("t_stop", s.agg(F.max("t_us")).scalar())


@book("scl_cosine", "WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], ref::DOUBLE[]), 4) AS c FROM embeddings JOIN r USING (label)")
def _(d: Data) -> DataFrame:
    e = d.embeddings
    ref = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return e.join(ref, "label").select("vec_id", F.round(fit.cosine(F.col("embedding"), F.col("ref")), 4).alias("c"))


# ---- sources and sinks: a written table read back is the table


def _round_trip(d: Data, name: str, df: DataFrame, write) -> str:
    path = scratch_dir(d.spark, name)
    write(df, path)
    return path


_NOCPX = "SELECT DISTINCT result_id, mouse_id, fold, model_name, round(test_score, 6) AS test_score, len(coef) AS n_coef FROM glm_results"


def _glm_rows(d: Data) -> DataFrame:
    return d.glm_results.distinct()


def _shape(df: DataFrame) -> DataFrame:
    return df.select("result_id", "mouse_id", "fold", "model_name", F.round("test_score", 6).alias("test_score"), F.when(F.col("coef").isNotNull(), F.size("coef")).cast("long").alias("n_coef"))


@book("src_parquet", _NOCPX)
def _(d: Data) -> DataFrame:
    return _shape(_glm_rows(d))


_VECTORS = "SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, len(embedding) AS n FROM embeddings"


def _total(v: str) -> Column:
    return F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total")


@book("src_npz", _VECTORS)
@book("snk_npz", _VECTORS)
def _(d: Data) -> DataFrame:
    """Vectors written as one archive per label and read back from the archives."""
    folder = scratch_dir(d.spark, "npz")
    e = d.embeddings.select("vec_id", "label", "embedding")
    arrays.write_npz(e, folder, "label", ["vec_id", "embedding"], ["vec_id"])
    z = arrays.read_npz(d.spark, folder)
    ids = z.where("name = 'vec_id'").select("file", "row", F.col("values")[0].cast("long").alias("vec_id"))
    v = z.where("name = 'embedding'").select("file", "row", "values")
    label = F.regexp_extract("file", r"label=(-?\d+)\.npz$", 1).cast("int").alias("label")
    return ids.join(v, ["file", "row"]).select("vec_id", label, _total("values"), F.size("values").alias("n"))


@book("src_npy", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def _(d: Data) -> DataFrame:
    """The arrays of an unpacked archive."""
    import zipfile

    folder, flat = scratch_dir(d.spark, "npz"), scratch_dir(d.spark, "npy")
    made = arrays.write_npz(d.embeddings.select(F.lit(0).alias("all"), "vec_id", "embedding"), folder, "all", ["vec_id", "embedding"], ["vec_id"]).collect()
    for r in made:  # one archive
        zipfile.ZipFile(r.file).extractall(re.sub(r"^file:/*", "/", flat))
    z = arrays.read_npy(d.spark, flat)
    name = F.regexp_extract("file", r"([^/]+)\.npy$", 1)
    ids = z.where(name == "vec_id").select("row", F.col("values")[0].cast("long").alias("vec_id"))
    return ids.join(z.where(name == "embedding").select("row", "values"), "row").select("vec_id", _total("values"))


@book("src_dispatch", _NOCPX)
def _(d: Data) -> DataFrame:
    return _shape(sources.read_any(d.spark, f"{d.dir}/glm_results.parquet").distinct())


@book("src_nwb", "SELECT session_id, count(DISTINCT unit_id) AS n_units, count(DISTINCT trial_id) AS n_trials FROM us LEFT JOIN tr USING (session_id) GROUP BY 1", "us tr")
def _(d: Data) -> DataFrame:
    u = d.unit_rows().groupBy("session_id").agg(F.count_distinct("unit_id").alias("n_units"))
    t = d.trial_rows().groupBy("session_id").agg(F.count_distinct("trial_id").alias("n_trials"))
    return u.join(t, "session_id", "left").withColumn("n_trials", F.coalesce("n_trials", F.lit(0)))


@book("src_nwb_multi", "WITH d AS (SELECT session_id, unit_id, min(day) AS day, any_value(depth) AS depth FROM (SELECT DISTINCT session_id, unit_id, day, depth FROM units WHERE session_id IS NOT NULL) GROUP BY 1, 2) SELECT session_id, unit_id, row_number() OVER (ORDER BY session_id, unit_id) - 1 AS global_id, CASE WHEN day = 0 THEN NULL ELSE depth END AS depth FROM d")
@book("cmp_cluster_data", "WITH d AS (SELECT session_id, unit_id, min(day) AS day, any_value(depth) AS depth FROM (SELECT DISTINCT session_id, unit_id, day, depth FROM units WHERE session_id IS NOT NULL) GROUP BY 1, 2) SELECT session_id, unit_id, row_number() OVER (ORDER BY session_id, unit_id) - 1 AS global_id, CASE WHEN day = 0 THEN NULL ELSE depth END AS depth FROM d")
def _(d: Data) -> DataFrame:
    """Many session folders, whose tables do not all have the same columns (those of day 0 lack the depth), as one table."""
    u = d.unit_rows("day", "depth").where("session_id is not null").groupBy("session_id", "unit_id").agg(F.min("day").alias("day"), F.first("depth").alias("depth"))
    root = scratch_dir(d.spark, "sessions")
    u.where("day = 0").drop("depth").write.partitionBy("session_id").parquet(f"{root}/learning")
    u.where("day <> 0 or day is null").write.partitionBy("session_id").parquet(f"{root}/expert")
    return sources.union_sessions(d.spark, [f"{root}/learning", f"{root}/expert", f"{root}/none"], ["session_id", "unit_id"]).select("session_id", "unit_id", "global_id", "depth")


_CSV = "SELECT DISTINCT result_id, mouse_id, session_id, analysis_type, significant FROM roc_results"


def _csv_source(d: Data) -> DataFrame:
    r = d.roc_results.select("result_id", "mouse_id", "session_id", "analysis_type", "significant").distinct()
    path = _round_trip(d, "csv", r, sources.write_csv)
    return sources.read_results(d.spark, path, "result_id long, mouse_id string, session_id string, analysis_type string, significant boolean")


@book("src_csv", "SELECT DISTINCT result_id, session_id, analysis_type, significant FROM roc_results")
@book("src_csv_glob", "SELECT DISTINCT result_id, session_id, analysis_type, significant FROM roc_results")
def _(d: Data) -> DataFrame:
    return _csv_source(d).select("result_id", "session_id", "analysis_type", "significant")


@book("src_csv_meta", "SELECT DISTINCT file_id, regexp_extract(file_path, '(?:^|[/\\\\])([A-Z]{2}\\d+)[/\\\\]', 1) AS mouse, TRY_CAST(regexp_extract(file_path, 'whisker_(\\d+)', 1) AS INT) AS behaviour_day FROM model_files")
def _(d: Data) -> DataFrame:
    p = F.col("file_path")
    return d.model_files.select("file_id", F.regexp_extract(p, r"(?:^|[/\\])([A-Z]{2}\d+)[/\\]", 1).alias("mouse"), F.regexp_extract(p, r"whisker_(\d+)", 1).try_cast("int").alias("behaviour_day")).distinct()


@book("src_csv_session", "SELECT s.session_id, coalesce(n, 0) AS n_rows, CASE WHEN n IS NULL THEN 'missing' ELSE 'ok' END AS status FROM (SELECT DISTINCT session_id FROM units) s LEFT JOIN (SELECT session_id, count(*) AS n FROM tr GROUP BY 1) t USING (session_id)", "tr")
def _(d: Data) -> DataFrame:
    return sources.session_status(d.units, d.trial_rows(), ["session_id"])


@book("src_roc_table", "SELECT result_id, sign(selectivity) AS si_sign FROM roc WHERE selectivity IS NOT NULL", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().where("selectivity is not null").select("result_id", F.signum("selectivity").cast("int").alias("si_sign"))


@book("src_taskmod", "SELECT DISTINCT result_id, mouse_id, p_value, z_score FROM neuron_results")
def _(d: Data) -> DataFrame:
    return d.neuron_results.select("result_id", "mouse_id", "p_value", "z_score").distinct()


@book("src_waveform", "WITH k AS (SELECT DISTINCT unit_id, lower(trim(bc_label)) AS k, depth FROM units) SELECT unit_id, min(depth) FILTER (k = 'good') AS good, min(depth) FILTER (k = 'mua') AS mua FROM k GROUP BY 1")
def _(d: Data) -> DataFrame:
    k = d.units.select("unit_id", F.lower(F.trim("bc_label")).alias("k"), "depth").distinct()
    return k.groupBy("unit_id").pivot("k", ["good", "mua"]).agg(F.min("depth"))


@book("src_excel", "SELECT mouse_id, CASE WHEN min(reward_group) = 1 THEN 'R+' ELSE 'R-' END AS reward_group FROM units WHERE mouse_id IS NOT NULL GROUP BY 1")
def _(d: Data) -> DataFrame:
    """The mouse reference sheet, written as a workbook and read from it."""
    folder = scratch_dir(d.spark, "sheets")
    m = d.units.where("mouse_id is not null").groupBy("mouse_id").agg(F.when(F.min("reward_group") == 1, "R+").otherwise("R-").alias("reward_group"))
    arrays.write_sheet(m, f"{folder}/mice.xlsx", "mice")
    return arrays.sheet_table(arrays.read_sheets(d.spark, folder), "mice", {"A": "mouse_id", "B": "reward_group"})


@book("src_synthetic")
def _(d: Data) -> DataFrame:
    """A session by rule: 10 units, 150 trials every two seconds, evoked rates that step at trial 75; draws by hashes."""
    u = d.spark.range(10).select(F.col("id").alias("unit_id"), F.element_at(F.array(*[F.lit(x) for x in (0.8, 0.6, 0.4, 0.2, 0.0)]), (F.col("id") % 5 + 1).cast("int")).alias("effect"))
    t = u.withColumn("trial_id", F.explode(F.sequence(F.lit(0), F.lit(149)))).withColumn("start_time", 1.0 + 2.0 * F.col("trial_id"))
    lam = (20 + F.when(F.col("trial_id") >= 75, 50 * F.col("effect")).otherwise(0.0)) * 0.05
    n = t.withColumn("n", F.floor(lam + F.pmod(F.xxhash64("unit_id", "trial_id"), F.lit(1000)) / 1000.0 * 2).cast("long"))
    return n.select("unit_id", "trial_id", "start_time", "n")


_SNK = "SELECT DISTINCT result_id, mouse_id, fold, model_name, round(test_score, 6) AS test_score, len(coef) AS n_coef FROM glm_results"


@book("snk_parquet", _SNK)
@book("snk_parquet_arrow", _SNK)
def _(d: Data) -> DataFrame:
    path = _round_trip(d, "parquet", _glm_rows(d), lambda df, p: sources.write_parquet(df, p, ["fold"]))
    return _shape(d.spark.read.parquet(path).withColumn("fold", F.col("fold").cast("int")))


@book("snk_csv", _SNK)
def _(d: Data) -> DataFrame:
    rows = _glm_rows(d)
    path = _round_trip(d, "csv", rows, sources.write_csv)
    text = d.spark.read.option("header", "true").schema(", ".join(f"`{c}` string" for c in rows.columns)).csv(path)
    return _shape(sources.from_exchange(text, T.StructType([f for f in rows.schema])))


@book("snk_multi", _SNK)
def _(d: Data) -> DataFrame:
    path = _round_trip(d, "both", _glm_rows(d), sources.write_both)
    return _shape(d.spark.read.parquet(f"{path}/parquet"))


@book("snk_versioned", _SNK)
def _(d: Data) -> DataFrame:
    path = scratch_dir(d.spark, "versioned")
    sources.write_versioned(_glm_rows(d).where("model_type = 'full'"), path, "20240101-aaaaaaa")  # an older version, to be passed over
    sources.write_versioned(_glm_rows(d), path, "20240202-bbbbbbb")
    return _shape(sources.read_latest(d.spark, path))


@book("snk_json", "SELECT 'bin_ms' AS name, '50' AS value UNION ALL SELECT 'closed', 'left'")
def _(d: Data) -> DataFrame:
    path = scratch_dir(d.spark, "params")
    sources.write_params(d.spark, path, {"bin_ms": 50, "closed": "left"})
    m = F.from_json("value", "map<string,string>")
    return d.spark.read.text(path).select(F.explode(m).alias("name", "value"))


@book("snk_compact", _SNK)
def _(d: Data) -> DataFrame:
    a, b = scratch_dir(d.spark, "chunks"), scratch_dir(d.spark, "compact")
    _glm_rows(d).repartition(16).write.parquet(a)
    sources.compact(d.spark, a, b)
    return _shape(d.spark.read.parquet(b))


@book("cmp_roc_sessions", "SELECT session_id, analysis_type, count(*) AS n FROM roc GROUP BY 1, 2", "roc")
def _(d: Data) -> DataFrame:
    return d.roc().groupBy("session_id", "analysis_type").agg(F.count("*").alias("n"))


@book("cmp_cluster_suite", "WITH g AS (SELECT DISTINCT result_id, mouse_id, neuron_id, fold, git_version, model_name, test_score FROM glm_results WHERE neuron_id IS NOT NULL) SELECT model_name, 'score' AS metric, round(avg(test_score), 6) AS v FROM g GROUP BY 1 UNION ALL SELECT model_name, 'n', CAST(count(*) AS DOUBLE) FROM g GROUP BY 1")
def _(d: Data) -> DataFrame:
    g = glm(d)
    a = g.groupBy("model_name").agg(F.round(F.avg("test_score"), 6).alias("v")).withColumn("metric", F.lit("score"))
    return a.unionByName(g.groupBy("model_name").agg(F.count("*").cast("double").alias("v")).withColumn("metric", F.lit("n"))).select("model_name", "metric", "v")


# ---- user-defined surface


@book("udf_registry")
def _(d: Data) -> DataFrame:
    """A metric given as a Python function of the columns, run as a grouped aggregate over Arrow batches."""
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        v = v.dropna()
        return float(v.quantile(0.9) - v.quantile(0.1)) if len(v) else None

    return d.roc().groupBy("analysis_type").agg(spread("auc").alias("spread"))


@book("udtf_conditions", "SELECT session_id, unit_id, cond FROM us, (SELECT unnest(['active', 'passive_pre', 'passive_post']) AS cond)", "us")
def _(d: Data) -> DataFrame:
    return d.unit_rows().withColumn("cond", F.explode(F.array(F.lit("active"), F.lit("passive_pre"), F.lit("passive_post"))))


# ---- streams


def _stream(d: Data) -> DataFrame:
    path = f"{d.dir}/events.parquet"
    schema = d.spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return d.spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


@book("str_windows", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(d: Data) -> DataFrame:
    w = streaming.windowed_rates(_stream(d), "ts", ["event_type"], "value", "1 day", late="60 days")
    t = streaming.run_available(w, f"w_{abs(hash(d.dir)) % 10**9}_{id(d)}", "complete")
    return t.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@book("str_bouts", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL), b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM e),
k AS (SELECT user_id, i, count(*) AS n, max(ts) + INTERVAL 30 MINUTE AS stop FROM b GROUP BY 1, 2) SELECT CASE WHEN n = 1 THEN 'single' WHEN n <= 3 THEN 'short_cluster' ELSE 'bout' END AS kind, count(*) AS n FROM k WHERE stop <= (SELECT max(ts) FROM events) - INTERVAL 60 MINUTE GROUP BY 1""")
def _(d: Data) -> DataFrame:
    b = streaming.bouts(_stream(d), "ts", ["user_id"], "30 minutes", "1 hour")
    t = streaming.run_available(b, f"b_{abs(hash(d.dir)) % 10**9}_{id(d)}", "append")
    return t.groupBy("kind").agg(F.count("*").alias("n"))


@book("str_refractory", "WITH RECURSIVE ev AS (SELECT user_id, epoch_us(ts) AS t_us FROM events WHERE ts IS NOT NULL), " + _fold_sql("ev", "user_id", 3_600_000_000) + " SELECT user_id, count(*) AS n FROM r GROUP BY 1")
def _(d: Data) -> DataFrame:
    r = streaming.refractory_stream(_stream(d).select("user_id", "ts"), "ts", "user_id", 3600.0)
    t = streaming.run_available(r, f"r_{abs(hash(d.dir)) % 10**9}_{id(d)}", "append")
    return t.groupBy("user_id").agg(F.count("*").alias("n"))


@book("str_dedup", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def _(d: Data) -> DataFrame:
    x = streaming.deduplicate(_stream(d), "ts", ["event_id"], "60 days")
    t = streaming.run_available(x.select("event_id", "event_type"), f"d_{abs(hash(d.dir)) % 10**9}_{id(d)}", "append")
    return t.groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES, ORACLE = book.queries, book.oracle
