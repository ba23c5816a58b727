"""Queries p2 to p7 over the test tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from axonlake.operators import consolidate as con, drift, hotkeys, kalman, orphans, regular
from axonlake.session import read_table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(read_table(spark, d, "raw_exports"))


def p2_fields(spark: SparkSession, d: str) -> DataFrame:
    """The consistent table's fields: how many files and values each canonical field has, and under how many names."""
    u = drift.unify(read_table(spark, d, "raw_exports"))
    return u.groupBy("kind", "field").agg(F.count_distinct("file_id").alias("n_files"), F.count("value").alias("n_values"), F.count_distinct("name").alias("n_names"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return con.consolidate(read_table(spark, d, "model_files")).where("repeat").select("file_id", "line_no")


def p3_manifest(spark: SparkSession, d: str) -> DataFrame:
    m = con.manifest(con.consolidate(read_table(spark, d, "model_files")))
    return m.agg(F.sum("n_records").alias("n_records"), F.sum("n_repeats").alias("n_repeats"), F.sum("n_bytes").alias("n_bytes"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record once, read back from the consolidated files."""
    return con.rewritten(read_table(spark, d, "model_files"))[0]


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The consolidated files' range metadata."""
    return con.rewritten(read_table(spark, d, "model_files"))[1].select("file_bytes", "n_records", "first_key", "last_key")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    f = kalman.flag_readings(read_table(spark, d, "samples"))
    return f.groupBy("session_id", "signal").agg(F.count("*").alias("n"), F.count_if("impossible").alias("n_impossible"), F.count_if("stuck").alias("n_stuck"), F.count_if("spike").alias("n_spike"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return kalman.implausible(kalman.flag_readings(read_table(spark, d, "samples")))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = [
        orphans.Reference("roc_results", read_table(spark, d, "roc_results"), "result_id", "session_id", "neuron_id", "computed_at", "session_id", "original_unit_id"),
        orphans.Reference("neuron_results", read_table(spark, d, "neuron_results"), "result_id", "mouse_id", "neuron_id", "computed_at", "mouse_id", "neuron_id"),
        orphans.Reference("glm_results", read_table(spark, d, "glm_results"), "result_id", "mouse_id", "neuron_id", "computed_at", "mouse_id", "neuron_id"),
    ]
    return orphans.orphan_references(refs, read_table(spark, d, "units"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("ref_table", "result_id")


def p5_by_month(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, d))


def _grids(spark: SparkSession, d: str) -> DataFrame:
    signals = regular.regular_grid(read_table(spark, d, "samples").withColumnRenamed("signal", "stream"), ["session_id", "stream"], step=0.25, reading_id="sample_id")
    units = read_table(spark, d, "units").select("session_id", F.concat(F.lit("imec"), F.col("imec_id").cast("string")).alias("stream"), "unit_id", "spike_times")
    spikes = units.distinct().select("session_id", "stream", F.explode("spike_times").alias("t"))
    return signals.unionByName(regular.event_rates(spikes, ["session_id", "stream"], step=1.0))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _grids(spark, d).where(F.col("status") != "observed").select("session_id", "stream", "cell")


def p6_grid(spark: SparkSession, d: str) -> DataFrame:
    g = _grids(spark, d)
    return g.groupBy("session_id", "stream").agg(F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"), F.count("*").alias("n_cells"), F.count_if(F.col("status") == "observed").alias("n_observed"))


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    """The regular series itself: the fitted value of every cell, its effective support and whether it is observed, filled or missing."""
    return _grids(spark, d).select("session_id", "stream", "cell", "n", F.round("value", 5).alias("value"), F.round("support", 5).alias("support"), "status")


def p7_profile(spark: SparkSession, d: str) -> DataFrame:
    p = hotkeys.weighted_profile(read_table(spark, d, "roc_results"), ["area_acronym_custom", "analysis_type"], "auc")
    return p.select("area_acronym_custom", "analysis_type", "n", "n_values", "n_distinct", *[F.round(c, 6).alias(c) for c in ("mode", "p25", "p50", "p75")])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["area_acronym_custom", "analysis_type"]
    p = hotkeys.weighted_profile(read_table(spark, d, "roc_results"), keys, "auc")
    return hotkeys.heavy_keys(p, keys, 0.015)


_ORPHAN = """
SELECT r.ref_table, r.result_id, r.scope, r.num, r.computed_at FROM (
  SELECT DISTINCT 'roc_results' AS ref_table, result_id, session_id AS scope, neuron_id AS num, computed_at FROM roc_results
  UNION ALL SELECT DISTINCT 'neuron_results', result_id, mouse_id, neuron_id, computed_at FROM neuron_results
  UNION ALL SELECT DISTINCT 'glm_results', result_id, mouse_id, neuron_id, computed_at FROM glm_results) r
WHERE r.num IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM (SELECT 1 AS kind, session_id AS scope, original_unit_id AS num, registered_at, deleted_at FROM units
                 UNION ALL SELECT 2, mouse_id, neuron_id, registered_at, deleted_at FROM units) u
  WHERE u.kind = CASE WHEN r.ref_table = 'roc_results' THEN 1 ELSE 2 END AND u.scope = r.scope AND u.num = r.num
    AND u.registered_at <= r.computed_at AND (u.deleted_at IS NULL OR u.deleted_at > r.computed_at))
"""

_CELLS = """
WITH data AS (
  SELECT DISTINCT session_id, signal AS stream, CAST(floor(t / 0.25) AS BIGINT) AS cell FROM samples WHERE value IS NOT NULL AND NOT isnan(value)
  UNION SELECT session_id, 'imec' || CAST(imec_id AS VARCHAR), CAST(floor(s) AS BIGINT) FROM (SELECT session_id, imec_id, unnest(spike_times) AS s FROM units) WHERE s IS NOT NULL)
"""

QUERIES = {f.__name__: f for f in (p2_found, p2_fields, p3_found, p3_manifest, p3_records, p3_ranges, p4_found, p4_flags, p5_found, p5_by_month, p6_found, p6_grid, p6_values, p7_found, p7_profile)}

_RECORDS = r"""
WITH line AS (
  SELECT file_id, written_at, mouse_id, lower(regexp_extract(file_path, '([^/\\]+)$', 1)) AS name, n_bytes, b.line_no, trim(b.line) AS line
  FROM (SELECT *, unnest(list_zip(string_split(body, chr(10)), range(1, len(string_split(body, chr(10))) + 1))) AS z FROM model_files) f,
       LATERAL (SELECT z[1] AS line, z[2] AS line_no) b
), rec AS (
  SELECT file_id, written_at, line_no, mouse_id, regexp_extract(name, '^([0-9a-f]+)_model', 1) AS git, regexp_extract(name, '_model_([a-z]+)_', 1) AS model_type,
         CAST(regexp_extract(name, 'fold[_ -]*([0-9]+)', 1) AS INT) AS fold, strlen(line) + 1 AS n_bytes,
         CAST(line ->> 'neuron_id' AS DOUBLE) AS neuron_id, line ->> 'model_name' AS model_name, CAST(line ->> 'lambda_opt' AS DOUBLE) AS lambda_opt,
         CAST(line ->> 'train_score' AS DOUBLE) AS train_score, CAST(line ->> 'test_score' AS DOUBLE) AS test_score, CAST(line ->> 'test_corr' AS DOUBLE) AS test_corr
  FROM line WHERE json_valid(line) AND line LIKE '{%}'
), num AS (
  SELECT *, row_number() OVER (PARTITION BY mouse_id, git, model_type, fold, neuron_id, model_name, lambda_opt, train_score, test_score, test_corr
                               ORDER BY written_at, file_id, line_no) AS rn FROM rec)
"""

ORACLE = {
    "p3_found": _RECORDS + "SELECT file_id, CAST(line_no AS INT) AS line_no FROM num WHERE rn > 1",
    "p3_manifest": _RECORDS + "SELECT CAST(count(*) FILTER (rn = 1) AS BIGINT) AS n_records, CAST(count(*) FILTER (rn > 1) AS BIGINT) AS n_repeats, CAST(sum(n_bytes) FILTER (rn = 1) AS BIGINT) AS n_bytes FROM num",
    "p3_records": _RECORDS + "SELECT git AS git_version, model_type, fold, mouse_id, neuron_id, model_name, lambda_opt, train_score, test_score, test_corr, written_at, file_id, CAST(line_no AS INT) AS line_no FROM num WHERE rn = 1",
    "p5_found": f"SELECT ref_table, result_id FROM ({_ORPHAN}) q",
    "p5_by_month": f"""
WITH o AS ({_ORPHAN}), k AS (
  SELECT o.*, CASE WHEN o.ref_table = 'roc_results' THEN (SELECT min(registered_at) FROM units u WHERE u.session_id = o.scope AND u.original_unit_id = o.num)
                   ELSE (SELECT min(registered_at) FROM units u WHERE u.mouse_id = o.scope AND u.neuron_id = o.num) END AS first_at FROM o)
SELECT ref_table, CAST(date_trunc('month', computed_at) AS DATE) AS month, CASE WHEN first_at IS NULL THEN 'unknown' WHEN first_at > computed_at THEN 'early' ELSE 'deleted' END AS state,
       count(*) AS n_refs, count(DISTINCT (scope, num)) AS n_keys FROM k GROUP BY 1, 2, 3""",
    "p6_found": _CELLS + """, edge AS (SELECT session_id, stream, min(cell) AS a, max(cell) AS z FROM data GROUP BY 1, 2),
     grid AS (SELECT session_id, stream, unnest(range(a, z + 1)) AS cell FROM edge)
SELECT session_id, stream, cell FROM grid WHERE NOT EXISTS (SELECT 1 FROM data d WHERE d.session_id = grid.session_id AND d.stream = grid.stream AND d.cell = grid.cell)""",
    "p6_grid": _CELLS + "SELECT session_id, stream, min(cell) AS first_cell, max(cell) AS last_cell, max(cell) - min(cell) + 1 AS n_cells, count(*) AS n_observed FROM data GROUP BY 1, 2",
    "p6_values": """
WITH r AS (SELECT DISTINCT session_id, signal AS stream, sample_id, t, value FROM samples WHERE value IS NOT NULL AND NOT isnan(value) AND t IS NOT NULL AND NOT isnan(t)),
e AS (SELECT session_id, stream, CAST(floor(s) AS BIGINT) AS c, count(*) AS v FROM (SELECT session_id, stream, unnest(spike_times) AS s FROM (SELECT DISTINCT session_id, 'imec' || CAST(imec_id AS VARCHAR) AS stream, unit_id, spike_times FROM units)) WHERE s IS NOT NULL AND NOT isnan(s) GROUP BY 1, 2, 3),
p AS (SELECT session_id, stream, CAST(floor(t / 0.25) AS BIGINT) AS c, t / 0.25 AS x, value AS v FROM r UNION ALL SELECT session_id, stream, c, c + 0.5, CAST(v AS DOUBLE) FROM e),
k AS (SELECT session_id, stream, c + o AS cell, o, v, u, pow(1 - pow(abs(u) / 1.5, 3), 3) + 1e-6 AS w FROM (SELECT p.*, o, x - (c + o + 0.5) AS u FROM p, (SELECT unnest([-1, 0, 1]) AS o)) WHERE abs(u) < 1.5),
m AS (SELECT session_id, stream, cell, count(*) FILTER (o = 0) AS n, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * v) AS t0, sum(w * u * v) AS t1, sum(w * w) AS q FROM k GROUP BY 1, 2, 3),
grid AS (SELECT session_id, stream, unnest(range(min(c), max(c) + 1)) AS cell FROM p GROUP BY 1, 2),
f AS (SELECT g.session_id, g.stream, g.cell, coalesce(n, 0) AS n, CASE WHEN s0 * s2 - s1 * s1 > 1e-3 * s0 * s0 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END AS v, coalesce(s0 * s0 / q, 0) AS support
      FROM grid g LEFT JOIN m ON m.session_id IS NOT DISTINCT FROM g.session_id AND m.stream IS NOT DISTINCT FROM g.stream AND m.cell = g.cell)
SELECT session_id, stream, cell, CAST(n AS BIGINT) AS n, CASE WHEN n > 0 OR support >= 1.5 THEN round(v, 5) END AS value, round(support, 5) AS support, CASE WHEN n > 0 THEN 'observed' WHEN support >= 1.5 THEN 'filled' ELSE 'missing' END AS status FROM f""",
    "p7_found": "SELECT area_acronym_custom, analysis_type FROM roc_results WHERE area_acronym_custom IS NOT NULL AND analysis_type IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 0.015 * (SELECT count(*) FROM roc_results)",
    "p7_profile": """
WITH r AS (SELECT area_acronym_custom, analysis_type, CASE WHEN isnan(auc) THEN NULL ELSE auc END AS auc FROM roc_results),
m AS (SELECT area_acronym_custom, analysis_type, auc, row_number() OVER (PARTITION BY area_acronym_custom, analysis_type ORDER BY count(*) DESC, auc) AS k FROM r WHERE auc IS NOT NULL GROUP BY 1, 2, 3)
SELECT r.area_acronym_custom, r.analysis_type, count(*) AS n, count(r.auc) AS n_values, count(DISTINCT r.auc) AS n_distinct, round(min(m.auc), 6) AS mode,
       round(quantile_cont(r.auc, 0.25), 6) AS p25, round(quantile_cont(r.auc, 0.5), 6) AS p50, round(quantile_cont(r.auc, 0.75), 6) AS p75
FROM r LEFT JOIN m ON m.k = 1 AND m.area_acronym_custom IS NOT DISTINCT FROM r.area_acronym_custom AND m.analysis_type IS NOT DISTINCT FROM r.analysis_type GROUP BY 1, 2""",
}
