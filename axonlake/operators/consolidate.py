"""Many tiny result files consolidated into few well-sized ones, every record kept and repeats found.

The files are parsed once; every task leaves its records as a run sorted by record and place of delivery. A range exchange
then brings together, per key range, the pieces of all runs, and the sort merges them (a sort that recognises presorted
pieces, and merges spilled ones from disk). The range key is the whole record followed by its place, so even a record
delivered millions of times, or a group that holds a third of all records, spreads over several ranges. In each merged range
a streaming pass compares every record with the one before it and sums the bytes kept. Only the first record of a range can
be a repeat of something outside it; the ranges' last records (one row per range) decide that. Output files follow from the
bytes kept in all ranges before, so neither their number nor their size depends on how many ranges or tasks did the work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from axonlake.session import materialise, scratch_dir

GROUP = ["git_version", "model_type", "fold"]
VALUES = ["neuron_id", "model_name", "lambda_opt", "train_score", "test_score", "test_corr"]
RECORD = [*GROUP, "mouse_id", *VALUES]
PLACE = ["written_at", "file_id", "line_no"]

_JSON = "neuron_id double, model_name string, lambda_opt double, train_score double, test_score double, test_corr double, _torn string"


def parse_result_files(files: DataFrame) -> DataFrame:
    """One row per record: its group (from the file name), its values, its place and its bytes.

    The name is taken after the last ``/`` or ``\\``; version and type count without regard to case, fold as a number.
    Parts that a name does not hold are null. Empty and null bodies hold no record; a line that is no complete JSON
    object, and a blank line, is no record but counts as a line. Numbers are compared as numbers, null equals null.
    """
    name = F.lower(F.regexp_extract("file_path", r"([^/\\]+)$", 1))
    part = lambda p: F.when(name.rlike(p), F.regexp_extract(name, p, 1))
    lines = files.select(
        "file_id", "written_at", "mouse_id",
        part(r"^([0-9a-f]+)_model").alias("git_version"),
        part(r"_model_([a-z]+)_").alias("model_type"),
        part(r"fold[_ -]*([0-9]+)").try_cast("int").alias("fold"),
        F.posexplode(F.split(F.col("body"), "\n")).alias("_i", "_line"),
    )
    text = F.trim(F.regexp_replace("_line", r"^\s+|\s+$", ""))
    lines = lines.withColumn("_line", text).where(F.col("_line").startswith("{") & F.col("_line").endswith("}"))
    o = F.from_json("_line", _JSON, {"columnNameOfCorruptRecord": "_torn", "mode": "PERMISSIVE"})
    rows = lines.withColumn("_o", o).where(F.col("_o").isNotNull() & F.col("_o._torn").isNull())
    return rows.select(*GROUP, "mouse_id", *[F.col(f"_o.{v}").alias(v) for v in VALUES], "written_at", "file_id", (F.col("_i") + 1).cast("int").alias("line_no"), (F.octet_length("_line") + 1).cast("long").alias("n_bytes"))


def _same_as_previous(pdf: pd.DataFrame, previous: tuple | None) -> np.ndarray:
    n = len(pdf)
    same = np.ones(n, bool)
    for c in RECORD:
        a = pdf[c].to_numpy()
        null = pd.isna(a)
        same[1:] &= ((a[1:] == a[:-1]) & ~null[1:] & ~null[:-1]) | (null[1:] & null[:-1])
    same[0] = previous is not None and all((pd.isna(x) and pd.isna(y)) or x == y for x, y in zip(previous, pdf[RECORD].iloc[0]))
    return same


ORDER = [*RECORD, *PLACE]


def sorted_runs(files: DataFrame) -> DataFrame:
    """The records of ``files``, parsed once and written to the shared folder; each part file is a run sorted by record and place."""
    return materialise(parse_result_files(files).sortWithinPartitions(*ORDER), "runs")


def stored_bytes(df: DataFrame) -> int:
    """The size of the files behind a table that was read from files (one number)."""
    sizes = df.select("_metadata.file_path", "_metadata.file_size").distinct()
    return sizes.agg(F.sum("file_size")).first()[0] or 0


def merge_runs(records: DataFrame, target_bytes: float = 128 << 20, ranges: int | None = None, range_bytes: int = 64 << 20) -> DataFrame:
    """The merged records with ``range_id``, ``out_file`` (from 0), ``repeat``, ``head`` and ``tail``.

    ``head`` and ``tail`` mark the first and last record of a range; the ``repeat`` of a head is still open. The result
    is written to the shared folder, each part file sorted by record and place. ``target_bytes`` of records (``n_bytes``, without
    repeats) go to an output file; files are filled evenly, so there are as few as the target allows. Without ``ranges`` their
    number is the records' bytes over ``range_bytes``, for small inputs that over 1 MB as far as the session has cores.
    """
    spark = records.sparkSession
    if ranges is None:
        size = records.agg(F.sum("n_bytes")).first()[0] or 0  # one number
        ranges = max(1, math.ceil(size / range_bytes), min(spark.sparkContext.defaultParallelism, math.ceil(size / (1 << 20))))
    runs = records.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER)
    names = records.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in records.schema) + ", range_id int, repeat boolean, head boolean, tail boolean, _upto long"

    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        previous, used, waiting = None, 0, None
        for pdf in it:
            if not len(pdf):
                continue
            pdf = pdf.reset_index(drop=True)
            pdf["range_id"] = np.int32(part)
            pdf["repeat"] = _same_as_previous(pdf, previous)
            pdf["head"] = False
            pdf["tail"] = False
            if waiting is None:
                pdf.loc[0, "head"] = True
            else:
                yield waiting
            kept = np.where(pdf["repeat"], 0, pdf["n_bytes"])
            end = used + np.cumsum(kept)
            pdf["_upto"] = end - kept
            used, previous = int(end[-1]), tuple(pdf[RECORD].iloc[-1])
            waiting = pdf[[*names, "range_id", "repeat", "head", "tail", "_upto"]]
        if waiting is not None:
            waiting = waiting.copy()
            waiting.loc[len(waiting) - 1, "tail"] = True
            yield waiting

    merged = materialise(runs.mapInPandas(scan, schema), "merged")
    # one row per range: the bytes kept before it
    last = merged.where("tail").select("range_id", (F.col("_upto") + F.when(F.col("repeat"), 0).otherwise(F.col("n_bytes"))).alias("_b"))
    total = last.agg(F.sum("_b")).first()[0] or 0  # one number
    n_files = max(1, math.ceil(total / target_bytes))
    before = last.select("range_id", (F.sum("_b").over(W.orderBy("range_id")) - F.col("_b")).alias("_before"))
    place = F.least(F.floor((F.col("_before") + F.col("_upto")) * F.lit(n_files) / F.lit(max(total, 1))), F.lit(n_files - 1)).cast("int")
    return merged.join(before, "range_id").select(*names, "range_id", place.alias("out_file"), "repeat", "head", "tail")


def settle_heads(merged: DataFrame) -> DataFrame:
    """``merged`` with the open head of each range decided: it is a repeat if the range before ends with the same record."""
    record = F.struct(*RECORD)
    edges = merged.where("head or tail").groupBy("range_id").agg(F.max(F.when(F.col("tail"), record)).alias("_last"), F.max(F.when(F.col("head"), record)).alias("_first"))
    before = F.lag("_last").over(W.orderBy("range_id"))  # one row per range
    again = edges.withColumn("_again", F.coalesce(before.eqNullSafe(F.col("_first")) & before.isNotNull(), F.lit(False))).select("range_id", "_again")
    heads = merged.where("head").join(again, "range_id").withColumn("repeat", F.col("_again")).drop("_again")
    return merged.where("not head").unionByName(heads).drop("head", "tail")


def consolidate(files: DataFrame, target_bytes: int = 128 << 20) -> DataFrame:
    """All records of ``files`` merged: the record, its place, its output file and whether it is a repeat.

    ``target_bytes`` is the size of an output file as it is stored; what a record takes there is measured on the sorted runs.
    Calling this parses and merges; only the choice of columns is left to the result.
    """
    runs = sorted_runs(files)
    said = runs.agg(F.sum("n_bytes")).first()[0] or 0
    return settle_heads(merge_runs(runs, target_bytes * said / max(stored_bytes(runs), 1) if said else target_bytes))


def manifest(merged: DataFrame) -> DataFrame:
    """Per output file: records kept, repeats left out, bytes of the records, and the first and last group and unit it holds."""
    kept = ~F.col("repeat")
    key = F.struct(*GROUP, "mouse_id", "neuron_id")
    return merged.groupBy("out_file").agg(
        F.count_if(kept).alias("n_records"), F.count_if("repeat").alias("n_repeats"), F.sum(F.when(kept, F.col("n_bytes")).otherwise(0)).alias("n_bytes"), F.min(F.when(kept, key)).alias("first_key"), F.max(F.when(kept, key)).alias("last_key"),
    )


def write_consolidated(merged: DataFrame, path: str) -> DataFrame:
    """Write the records that are no repeats, sorted, one Parquet file per output file, with the metadata of every file's range.

    The metadata (file_name, file_bytes, n_records, first_key, last_key) are stored in ``path/_ranges``, which a reader of ``path``
    skips, and returned. They are taken from the files as written.
    """
    spark = merged.sparkSession
    kept = merged.where("not repeat")
    n = (kept.agg(F.max("out_file")).first()[0] or 0) + 1
    # each output file is one task of its own: no sampling, no collisions
    kept.repartitionById(n, F.col("out_file")).sortWithinPartitions(*ORDER).select(*ORDER).write.option("maxRecordsPerFile", 0).mode("overwrite").parquet(path)
    key = F.struct(*GROUP, "mouse_id", "neuron_id")
    back = spark.read.parquet(path)
    found = back.groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.max("_metadata.file_size").alias("file_bytes"), F.count("*").alias("n_records"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    found.write.mode("overwrite").parquet(f"{path}/_ranges")
    return read_ranges(spark, path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """The range metadata of a consolidated folder."""
    return spark.read.parquet(f"{path}/_ranges")


def rewritten(files: DataFrame, target_bytes: int = 128 << 20) -> tuple[DataFrame, DataFrame]:
    """Consolidate ``files`` into a folder of the shared scratch space: the records read back from it, and its range metadata."""
    path = scratch_dir(files.sparkSession, "consolidated")
    ranges = write_consolidated(consolidate(files, target_bytes), path)
    return files.sparkSession.read.parquet(path), ranges
