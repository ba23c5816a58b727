"""Incremental forms of the stateful pieces: refractory filtering, block rates, session windows, late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from axonlake.session import scratch_dir


def windowed_rates(events: DataFrame, ts: str, by: list[str], value: str, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum per tumbling or sliding window; rows later than ``late`` are dropped, state is bounded by it."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "total")


def bouts(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Bouts: events of a key less than ``gap`` apart; kind single, short_cluster (up to 3) or bout."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    kind = F.when(F.col("n") == 1, "single").when(F.col("n") <= 3, "short_cluster").otherwise("bout")
    return g.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", kind.alias("kind"))


def deduplicate(events: DataFrame, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark's reach."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def refractory_stream(events: DataFrame, ts: str, key: str, seconds: float, late: str = "10 minutes") -> DataFrame:
    """The greedy refractory filter with the last kept time of each key as state: key, ts of kept events, batch by batch in order of time.

    An event at or before the reach of the last kept one is dropped, and with it one that comes late into a time already decided;
    so are events behind the watermark (``late``). The state of a key ends once the watermark has passed the reach of its last
    kept event, as nothing that may still come depends on it. Null times are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    schema = f"{key} {dict(events.dtypes)[key]}, {ts} timestamp"
    reach = int(seconds * 1_000_000)

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [], ts: []})
            return
        last = state.get[0] if state.exists else None
        times = pd.concat([b[ts] for b in batches]).dropna().sort_values().to_numpy("datetime64[us]")
        us = times.astype("int64")
        kept = []
        i = 0 if last is None else int(us.searchsorted(last + reach, "right"))
        while i < len(us):  # from one kept event to the next
            kept.append(i)
            last = int(us[i])
            i = int(us.searchsorted(last + reach, "right"))
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + reach) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(kept), ts: times[kept]})

    return events.withWatermark(ts, late).groupBy(key).applyInPandasWithState(keep, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming frame over what is there now and return the result, which is written to the shared folder batch by batch.

    A batch that is repeated after a failure overwrites its own output. In ``complete`` mode the last batch is the result.
    """
    spark = df.sparkSession
    root = scratch_dir(spark, f"stream-{name}")

    def put(batch: DataFrame, i: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={i}")

    q = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    empty = spark.createDataFrame([], df.schema)
    try:
        out = spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out")
    except AnalysisException:  # there was nothing to run over
        return empty
    if mode == "complete":
        out = out.where(F.col("batch") == out.agg(F.max("batch")).scalar())
    return out.select(*df.columns)
