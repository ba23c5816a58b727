"""Queries p1, p8, p9 and p10 over the test tables, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from axonlake.llm import languages, mixing, packing, percentiles
from axonlake.session import read_table

_P = (0.05, 0.25, 0.5, 0.75, 0.95)


def _values(spark: SparkSession, d: str) -> DataFrame:
    u = read_table(spark, d, "units").select(F.lit("firing_rate").alias("measure"), F.col("ccf_parent_acronym").alias("area"), F.col("day").cast("string").alias("part"), F.col("firing_rate").alias("v"))
    n = read_table(spark, d, "neuron_results").select(F.lit("shift_magnitude").alias("measure"), "area", F.col("session_id").alias("part"), F.col("shift_magnitude").alias("v"))
    return u.unionByName(n)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = percentiles.percentiles_by_bisection(_values(spark, d), ["measure", "area"], "v", _P)
    return p.select("measure", "area", "percentile", "n", F.round("value", 6).alias("value"))


def p1_by_part(spark: SparkSession, d: str) -> DataFrame:
    """Per area and day (units) or session (results)."""
    p = percentiles.percentiles_by_bisection(_values(spark, d), ["measure", "area", "part"], "v", (0.5, 0.9))
    return p.select("measure", "area", "part", "percentile", "n", F.round("value", 6).alias("value"))


def p1_combined(spark: SparkSession, d: str) -> DataFrame:
    """Summaries per part added up, then bounded percentiles from them: the bounds hold the exact value."""
    keys = ["measure", "area"]
    whole = percentiles.combine(percentiles.summarise(_values(spark, d), keys, "v", ["part"]), keys)
    exact = percentiles.percentiles_by_bisection(_values(spark, d), keys, "v", (0.5,), summary=whole).select(F.col("measure").alias("m"), F.col("area").alias("a"), F.col("value").alias("x"))
    p = percentiles.from_summary(whole, keys, (0.5,))
    j = p.join(exact, F.col("measure").eqNullSafe(F.col("m")) & F.col("area").eqNullSafe(F.col("a")))
    return j.select("measure", "area", "n", F.round("x", 6).alias("median"), ((F.col("x") >= F.col("lower") - 1e-9) & (F.col("x") <= F.col("upper") + 1e-9)).alias("bounded"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents")).where("piece > 0").select("doc_id").distinct()


def p8_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(read_table(spark, d, "documents")))


def _mix(spark: SparkSession, d: str, budget: float | str = "corpus") -> tuple[DataFrame, DataFrame]:
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"), budget=budget)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Through the drawn documents: the sources that the draw used up below their target."""
    return mixing.exhausted(_mix(spark, d)[1])


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_feasible(spark: SparkSession, d: str) -> DataFrame:
    """The report of the largest mix in which every source with documents reaches its share."""
    return _mix(spark, d, "feasible")[1]


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d, "feasible")[0]


def p9_margins(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and reached shares of every source, language and topic, with what is left between them."""
    return mixing.plan(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"), budget="feasible")[2]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.wrong_labels(read_table(spark, d, "documents"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return languages.document_languages(languages.segment_languages(docs, languages.train_trees(docs), every=True))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    return languages.segment_languages(docs, languages.train_trees(docs))


QUERIES = {f.__name__: f for f in (p1_by_part, p1_percentiles, p1_combined, p8_found, p8_sequences, p8_report, p9_found, p9_report, p9_feasible, p9_documents, p9_margins, p10_found, p10_documents, p10_segments)}

_V = """WITH v AS (
  SELECT 'firing_rate' AS measure, ccf_parent_acronym AS area, CAST(day AS VARCHAR) AS part, firing_rate AS v FROM units WHERE firing_rate IS NOT NULL AND NOT isnan(firing_rate)
  UNION ALL SELECT 'shift_magnitude', area, session_id, shift_magnitude FROM neuron_results WHERE shift_magnitude IS NOT NULL AND NOT isnan(shift_magnitude))
"""


def _quantiles(by: str, ps: tuple[float, ...]) -> str:
    return _V + " UNION ALL ".join(f"SELECT {by}, CAST({p} AS DOUBLE) AS percentile, count(*) AS n, round(quantile_cont(v, {p}), 6) AS value FROM v GROUP BY {by}" for p in ps)


ORACLE = {
    "p1_percentiles": _quantiles("measure, area", _P),
    "p1_by_part": _quantiles("measure, area, part", (0.5, 0.9)),
    "p1_combined": _V + "SELECT measure, area, count(*) AS n, round(quantile_cont(v, 0.5), 6) AS median, true AS bounded FROM v GROUP BY 1, 2",
}
