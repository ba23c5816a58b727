"""How queries are registered, and the views of the test tables that many of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from axonlake.operators.interval import micros, spikes_of
from axonlake.session import read_table


class Data:
    """The tables of one scale factor: ``Data(spark, dir).units`` reads ``dir/units.parquet``."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name)

    def unit_rows(self, *cols: str) -> DataFrame:
        """Units without repeated rows."""
        return self.units.select(*dict.fromkeys(["session_id", "unit_id", *cols])).distinct()

    def spikes(self) -> DataFrame:
        """session_id, unit_id, t_us."""
        return spikes_of(self.unit_rows("spike_times"), ["session_id", "unit_id"])

    def trial_rows(self) -> DataFrame:
        """Trials without repeated rows, with at_us, event_id and a cleaned context."""
        t = self.trials.distinct()
        return t.withColumn("at_us", micros(F.col("start_time"))).withColumn("event_id", F.col("trial_id")).withColumn("ctx", context(F.col("context")))

    def roc(self) -> DataFrame:
        """ROC results without repeated rows; NaN selectivity and auc are null."""
        r = self.roc_results.drop("fpr", "tpr", "thresholds").distinct()
        return r.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("auc", "selectivity", "p_value")})


def context(c: Column) -> Column:
    """active or passive, whatever the spelling; null counts as active."""
    low = F.lower(F.trim(c))
    return F.when(low.isNull() | (low == "nan"), "active").when(low.startswith("passi"), "passive").otherwise(low)


#: Common table expressions with the same content as the methods of ``Data``.
CTE = {
    "u": "u AS (SELECT DISTINCT mouse_id, session_id, unit_id, day, reward_group, neuron_id, cluster_id, imec_id, electrode_group, depth, bc_label, firing_rate, presenceRatio, duration, waveformDuration_peakTrough, spike_times, waveform_mean, ccf_acronym, ccf_parent_acronym, target_region, area_acronym_custom, ccf_ap, ccf_ml, ccf_dv FROM units)",
    "us": "us AS (SELECT DISTINCT session_id, unit_id FROM units)",
    "sp": "sp AS (SELECT session_id, unit_id, CAST(round(s * 1000000) AS BIGINT) AS t_us FROM (SELECT session_id, unit_id, unnest(spike_times) AS s FROM (SELECT DISTINCT session_id, unit_id, spike_times FROM units)) WHERE s IS NOT NULL AND NOT isnan(s))",
    "tr": "tr AS (SELECT *, CAST(round(start_time * 1000000) AS BIGINT) AS at_us, trial_id AS event_id, CASE WHEN context IS NULL OR lower(trim(context)) = 'nan' THEN 'active' WHEN lower(trim(context)) LIKE 'passi%' THEN 'passive' ELSE lower(trim(context)) END AS ctx FROM (SELECT DISTINCT * FROM trials))",
    "roc": "roc AS (SELECT * REPLACE (CASE WHEN isnan(auc) THEN NULL ELSE auc END AS auc, CASE WHEN isnan(selectivity) THEN NULL ELSE selectivity END AS selectivity, CASE WHEN isnan(p_value) THEN NULL ELSE p_value END AS p_value) FROM (SELECT DISTINCT result_id, mouse_id, session_id, neuron_id, cluster_id, area_acronym_custom, analysis_type, auc, selectivity, significant, direction, p_value, computed_at FROM roc_results))",
}


class Book:
    """The queries of one module: ``@book("name", sql)`` registers a function of ``Data``."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None, ctes: str = "") -> Callable:
        def add(f: Callable[[Data], DataFrame]) -> Callable:
            assert name not in self.queries, name
            self.queries[name] = lambda spark, d: f(Data(spark, d))
            if sql:
                used = [CTE[c] for c in ctes.split()]
                body = sql.strip()
                if used:
                    body = "WITH " + ", ".join(used) + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
                self.oracle[name] = body
            return f

        return add
