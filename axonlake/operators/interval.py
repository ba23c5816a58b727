"""Interval and as-of joins of a point process against events.

Times are whole microseconds (``t_us``), so that window edges are exact. A window join is an equi join on time buckets:
a point falls in one bucket, a window is repeated for the few buckets it touches, and the exact predicate decides; so the
work follows the matches, not the product of points and windows of a key.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def micros(seconds: Column) -> Column:
    """Seconds as whole microseconds; null and NaN become null."""
    return F.when(~F.isnan(seconds), F.round(seconds * 1_000_000)).cast("long")


def spikes_of(units: DataFrame, keep: list[str]) -> DataFrame:
    """The exploded fact table of an array-valued unit table: kept columns and t_us. Null or empty trains give no rows."""
    return units.select(*keep, F.explode("spike_times").alias("_t")).select(*keep, micros(F.col("_t")).alias("t_us")).where("t_us is not null")


def range_join(points: DataFrame, events: DataFrame, keys: list[str], start: int, stop: int, closed: str = "left", bucket: int | None = None, at: str = "at_us") -> DataFrame:
    """Points joined to every event of their key with ``at + start <= t_us < at + stop`` (``<=`` if ``closed`` is ``both``).

    Result: the columns of both sides (keys once). Columns other than the keys must have different names. Null keys and
    times match nothing. ``bucket`` (microseconds) defaults to the width of the window.
    """
    width = bucket or max(1, stop - start)
    p = points.withColumn("_b", F.floor(F.col("t_us") / F.lit(width)))
    e = events.withColumn("_b", F.explode(F.sequence(F.floor((F.col(at) + F.lit(start)) / F.lit(width)), F.floor((F.col(at) + F.lit(stop)) / F.lit(width)))))
    upper = F.col("t_us") <= F.col(at) + F.lit(stop) if closed == "both" else F.col("t_us") < F.col(at) + F.lit(stop)
    return p.join(e, [*keys, "_b"]).where((F.col("t_us") >= F.col(at) + F.lit(start)) & upper).drop("_b")


def count_in_window(points: DataFrame, units: DataFrame, events: DataFrame, keys: list[str], unit: list[str], event: list[str], start: int, stop: int, closed: str = "left", name: str = "n") -> DataFrame:
    """Points per unit and event in the window, zeros included: keys..., unit..., event..., ``name``.

    ``units`` and ``events`` span the result: every unit with every event of its key.
    """
    hits = range_join(points, events, keys, start, stop, closed).groupBy(*keys, *unit, *event).agg(F.count("*").alias(name))
    spine = units.select(*keys, *unit).join(events.select(*keys, *event), keys)
    return spine.join(hits, [*keys, *unit, *event], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))


def raster(points: DataFrame, events: DataFrame, keys: list[str], start: int, stop: int, closed: str = "both") -> DataFrame:
    """Range join with ``t_rel_us``, the time of a point from its event."""
    return range_join(points, events, keys, start, stop, closed).withColumn("t_rel_us", F.col("t_us") - F.col("at_us"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, value: str, direction: str = "nearest", bucket: int = 600_000_000) -> DataFrame:
    """As-of join: each left row with the ``value`` and time (``match_t``) of the nearest right row of its key.

    Both sides are sorted together per key and ``bucket`` of time; what lies beyond a bucket comes from the buckets' own first and
    last right rows, one small row per bucket, so no task sorts a whole key. Of two equally near rows the earlier one wins; of
    right rows at one time the one with the smallest value. ``direction``: nearest, backward (at or before) or forward. No match,
    or a null time on the left: nulls. Null keys match null keys.
    """
    cols = left.columns
    a = left.select(*keys, F.col(left_t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.struct(*cols).alias("_row"))
    r = right.where(F.col(right_t).isNotNull()).groupBy(*keys, F.col(right_t).alias("_t")).agg(F.min(value).alias("_v"))
    b = r.select(*keys, "_t", F.lit(0).alias("_side"), "_v", F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    hit = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    u = a.unionByName(b).withColumn("_b", F.floor(F.col("_t") / F.lit(bucket)))
    w = W.partitionBy(*keys, "_b")
    u = u.withColumn("_back", F.last(hit, ignorenulls=True).over(w.orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)))
    u = u.withColumn("_fore", F.last(hit, ignorenulls=True).over(w.orderBy(F.desc("_t"), "_side").rowsBetween(W.unboundedPreceding, 0))).where("_side = 1")
    # the buckets of both sides with their first and last right row, and what the buckets before and behind hold
    inner = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, inner)]
    ends = a.select(*named, F.floor(F.col("_t") / F.lit(bucket)).alias("_c"), F.lit(None).cast(b.schema["_t"].dataType).alias("_t"), "_v")
    ends = ends.unionByName(b.select(*named, F.floor(F.col("_t") / F.lit(bucket)).alias("_c"), "_t", "_v")).where("_c is not null")
    own = F.when(F.col("_t").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_v").alias("v")))
    ends = ends.groupBy(*inner, "_c").agg(F.min(own).alias("_first"), F.max(own).alias("_last"))
    g = W.partitionBy(*inner)
    ends = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(g.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)))
    ends = ends.withColumn("_after", F.last("_first", ignorenulls=True).over(g.orderBy(F.desc("_c")).rowsBetween(W.unboundedPreceding, -1)))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, inner)] + [F.col("_b") == F.col("_c")]
    u = u.join(ends.select(*inner, "_c", "_before", "_after"), on, "left")
    u = u.withColumn("_back", F.coalesce("_back", "_before")).withColumn("_fore", F.coalesce("_fore", "_after"))
    back, fore = F.col("_back"), F.col("_fore")
    near = F.when(fore.isNull() | (F.col("_t") - back["t"] <= fore["t"] - F.col("_t")), back).otherwise(fore)
    pick = {"nearest": F.coalesce(near, fore), "backward": back, "forward": fore}[direction]
    return u.withColumn("_m", pick).select(*[F.col(f"_row.{c}").alias(c) for c in cols], F.col("_m.t").alias("match_t"), F.col("_m.v").alias(value))


def drop_near(points: DataFrame, reference: DataFrame, keys: list[str], within: int, t: str = "t_us", ref_t: str = "ref_us") -> DataFrame:
    """Points without a reference event in ``(0, within]`` before them."""
    p = points.withColumn("_b", F.explode(F.array_distinct(F.array(F.floor(F.col(t) / F.lit(within)), F.floor((F.col(t) - F.lit(within)) / F.lit(within))))))
    r = reference.select(*keys, ref_t, F.floor(F.col(ref_t) / F.lit(within)).alias("_b"))
    near = p.join(r, [*keys, "_b"]).where((F.col(t) > F.col(ref_t)) & (F.col(t) - F.col(ref_t) <= F.lit(within))).select(*keys, t).distinct()
    return points.join(near, [*keys, t], "left_anti")


def _whole_groups(it: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Batches of a stream sorted by ``keys`` that hold whole groups only, with the places where groups begin and the end."""
    held = None
    for pdf in it:
        if not len(pdf):
            continue
        pdf = pdf.reset_index(drop=True) if held is None else pd.concat([held, pdf], ignore_index=True)
        differs = np.zeros(len(pdf) - 1, bool)
        for c in keys:
            v = pdf[c].to_numpy()
            null = pd.isna(v)
            differs |= (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (v[1:] != v[:-1]))
        cuts = [0, *(np.flatnonzero(differs) + 1).tolist()]
        if len(cuts) > 1:
            yield pdf.iloc[: cuts[-1]], cuts
        held = pdf.iloc[cuts[-1] :].reset_index(drop=True)
    if held is not None:
        yield held, [0, len(held)]


def _chain_ends(v: list[int], interval: int) -> list[int]:
    """For every point of a sorted list the last point kept if it is kept."""
    n = len(v)
    out, nxt = v[:], n
    for i in range(n - 1, -1, -1):
        while nxt - 1 > i and v[nxt - 1] - v[i] > interval:
            nxt -= 1
        if nxt < n:
            out[i] = out[nxt]
    return out


def refractory(points: DataFrame, keys: list[str], interval: int, t: str = "t_us", bucket: int | None = None) -> DataFrame:
    """Greedy filter: a point is kept if it is more than ``interval`` after the last kept one (the first is always kept).

    The rule depends on what was kept, but between two stretches of time only by the last kept time. So every ``bucket`` of a key
    (4,096 intervals by default) first says by itself where it would end for each point it could start with (those within one
    interval); these few numbers are chained per key; then every bucket is filtered from its true start. No task holds more than a
    bucket of points. Repeated times count once, null times are left out.
    """
    width = bucket or 4096 * interval
    inner = [f"_k{i}" for i in range(len(keys))]
    types = [points.schema[k].dataType.simpleString() for k in keys]
    head = ", ".join(f"{n} {v}" for n, v in zip(inner, types))
    d = points.where(F.col(t).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, inner)], F.col(t).cast("long").alias("_t")).withColumn("_b", F.floor(F.col("_t") / F.lit(width)))
    d = d.repartition(*inner, "_b").dropDuplicates([*inner, "_b", "_t"])

    def ends(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _whole_groups(it, [*inner, "_b"]):
            t_, starts, stops = pdf["_t"].tolist(), [], []
            for a, z, b in zip(cuts, cuts[1:], pdf["_b"].to_numpy()[cuts[:-1]].tolist()):
                v = t_[a:z]
                can = bisect_right(v, b * width + interval) + 1
                starts.append(v[:can])
                stops.append(_chain_ends(v, interval)[:can])
            yield pdf.iloc[cuts[:-1]][[*inner, "_b"]].assign(_starts=starts, _ends=stops)

    def chain(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _whole_groups(it, inner):
            enter, starts, stops = [], pdf["_starts"].tolist(), pdf["_ends"].tolist()
            for a, z in zip(cuts, cuts[1:]):
                last = None
                for s, e in zip(starts[a:z], stops[a:z]):
                    enter.append(last)
                    i = 0 if last is None else bisect_right(s, last + interval)
                    if i < len(s):
                        last = int(e[i])
            yield pdf[[*inner, "_b"]].assign(_known=[x is not None for x in enter], _enter=[x or 0 for x in enter])

    def keep(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, cuts in _whole_groups(it, [*inner, "_b"]):
            t_, kept = pdf["_t"].tolist(), []
            known, enter = pdf["_known"].to_numpy()[cuts[:-1]].tolist(), pdf["_enter"].to_numpy()[cuts[:-1]].tolist()
            for a, z, there, last in zip(cuts, cuts[1:], known, enter):
                i = a if not there else bisect_right(t_, last + interval, a, z)
                while i < z:
                    kept.append(i)
                    i = bisect_right(t_, t_[i] + interval, i + 1, z)
            yield pdf.iloc[kept][[*inner, "_t"]]

    small = d.sortWithinPartitions(*inner, "_b", "_t").mapInPandas(ends, f"{head}, _b long, _starts array<long>, _ends array<long>")
    entry = small.repartition(*inner).sortWithinPartitions(*inner, "_b").mapInPandas(chain, f"{head}, _b long, _known boolean, _enter long")
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"e.{k}")) for k in inner] + [F.col("d._b") == F.col("e._b")]
    j = d.alias("d").join(entry.alias("e"), on).select("d.*", "e._known", "e._enter").repartition(*inner, "_b").sortWithinPartitions(*inner, "_b", "_t")
    out = j.mapInPandas(keep, f"{head}, _t long")
    return out.select(*[F.col(n).alias(k) for n, k in zip(inner, keys)], F.col("_t").alias(t))


def nearest_grid(points: DataFrame, grid: DataFrame, keys: list[str], t: str, depth: str, t_bin: str = "t_bin", depth_bin: str = "depth_bin", value: str = "displacement") -> DataFrame:
    """Each point with the grid value of the nearest depth bin at the nearest time bin (earlier and shallower on a tie)."""
    bins = grid.groupBy(*keys, t_bin).agg(F.collect_list(F.struct(depth_bin, value)).alias("_field"))
    at = nearest(points, bins.withColumn("_field_t", F.to_json("_field")), keys, t, t_bin, "_field_t")
    field = F.from_json("_field_t", f"array<struct<{depth_bin}:double,{value}:double>>")
    best = F.array_min(F.transform(field, lambda x: F.struct(F.abs(x[depth_bin] - F.col(depth)).alias("d"), x[depth_bin].alias("b"), x[value].alias("v"))))
    return at.withColumn("_best", best).select(*points.columns, F.col("match_t").alias(t_bin), F.col("_best.b").alias(depth_bin), F.col("_best.v").alias(value))
