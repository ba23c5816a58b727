"""Readers and writers: tables by suffix, many result files with path-derived columns, nested arrays, versioned output."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from axonlake.session import materialise


def read_any(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """A table by its suffix (parquet, csv, json, jsonl, orc, text); a folder is Parquet. CSV and JSON need a schema in production."""
    ext = re.sub(r"[*?{},\[\]]", "", path.rstrip("/").rsplit("/", 1)[-1]).rpartition(".")[2].lower()
    fmt = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "orc": "orc", "txt": "text", "avro": "avro"}.get(ext, "parquet")
    r = spark.read.format(fmt)
    if fmt == "csv":
        r = r.option("header", "true").option("sep", "\t" if ext == "tsv" else ",")
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def read_results(spark: SparkSession, root: str, schema: str | T.StructType, pattern: str = "*.csv", strict: bool = False) -> DataFrame:
    """All result files below ``root`` with path-derived columns: file, mouse_id and session_day from the folders.

    Missing and corrupt files are skipped unless ``strict``; malformed rows are dropped. One scan, no listing per file.
    """
    r = spark.read.format("csv").schema(schema).option("header", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    if not strict:
        r = r.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("mode", "DROPMALFORMED")
    return with_path_columns(r.load(root))


def with_path_columns(df: DataFrame) -> DataFrame:
    """``df`` with file, mouse_id, behaviour_day and learning_group (learner for day 0, expert later) from its file path."""
    path = F.col("_metadata.file_path")
    day = F.regexp_extract(path, r"/whisker_(\d+)/", 1).try_cast("int")
    mouse = F.nullif(F.regexp_extract(path, r"/([A-Z]{2}\d+)/", 1), F.lit(""))
    return df.withColumns({"file": path, "mouse_id": mouse, "behaviour_day": day, "learning_group": F.when(day == 0, "learner").when(day > 0, "expert")})


def session_status(expected: DataFrame, found: DataFrame, keys: list[str], failed: DataFrame | None = None) -> DataFrame:
    """Each expected session with its rows and a status: ok, empty, missing or failed."""
    n = found.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    out = expected.select(*keys).distinct().join(n, keys, "left")
    if failed is not None:
        out = out.join(failed.select(*keys).distinct().withColumn("_f", F.lit(True)), keys, "left")
    else:
        out = out.withColumn("_f", F.lit(None).cast("boolean"))
    s = F.when(F.col("_f"), "failed").when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows") == 0, "empty").otherwise("ok")
    return out.withColumn("status", s).withColumn("n_rows", F.coalesce("n_rows", F.lit(0))).drop("_f")


def union_sessions(spark: SparkSession, paths: list[str], order: list[str], strict: bool = False) -> DataFrame:
    """The tables below several folders as one, missing columns null, with ``global_id`` from 0 in ``order``.

    A folder that is not there or holds no table is skipped unless ``strict``. Ids come from counts per range of the order, so no
    task sees all rows.
    """
    out = None
    for p in paths:
        try:
            one = spark.read.parquet(p)
        except AnalysisException:
            if strict:
                raise
            continue
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("none of the folders holds a table")
    ranged = out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = materialise(ranged, "sessions")  # the ranges are sampled: written once, so that both uses see the same
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = sizes.select("_p", "_first", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))  # one row per range
    return ranged.join(before, "_p").withColumn("global_id", F.col("_before") + F.col("_i") - F.col("_first")).drop("_p", "_i", "_first", "_before")


def exchangeable(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that any flat format can hold the table; null stays null."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def from_exchange(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse of ``exchangeable``."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.from_json(F.col(f"`{f.name}`"), f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    exchangeable(df).write.mode(mode).option("header", "true").csv(path)


def write_both(df: DataFrame, path: str) -> None:
    """The same frame as Parquet and CSV; the Parquet copy is written first and read for the second, so the plan runs once."""
    write_parquet(df, f"{path}/parquet")
    write_csv(df.sparkSession.read.parquet(f"{path}/parquet"), f"{path}/csv")


def write_versioned(df: DataFrame, path: str, version: str, mode: str = "append") -> None:
    """Output under ``version=...``, so that several versions live side by side and readers prune by it."""
    df.withColumn("version", F.lit(version)).write.mode(mode).partitionBy("version").parquet(path)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the greatest version."""
    df = spark.read.parquet(path)
    return df.where(F.col("version") == df.agg(F.max("version")).scalar())


def write_params(spark: SparkSession, path: str, params: dict) -> None:
    """A JSON sidecar of run parameters."""
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = 128 << 20) -> int:
    """Parquet chunks rewritten as files of about ``target_bytes``; returns their number."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(source)
    size = p.getFileSystem(conf).getContentSummary(p).getLength()
    n = max(1, -(-size // target_bytes))
    spark.read.parquet(source).repartition(int(n)).write.mode("overwrite").parquet(target)
    return int(n)
