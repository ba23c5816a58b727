"""Percentiles of very large numeric columns per group by bisection of value intervals.

For every group and target rank an interval of values is kept that is known to hold the rank. Each pass counts the rows
of all open intervals below a set of midpoints (``sections`` of them, so one pass does the work of several halvings) and
narrows each interval to the section that holds its rank, until the section holds one value. Counts are sums, so they
combine over partitions, days and earlier runs: the first pass works from a summary of fixed sections that can be stored
per part and added up later; alone it already bounds the error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from axonlake.session import materialise

#: Fixed sections per unit of asinh(value): a relative error of 1/FINE for large values, an absolute one near zero.
FINE = 64


def _scale(v: Column) -> Column:
    return F.least(F.greatest(F.asinh(v), F.lit(-1000.0)), F.lit(1000.0))


def summarise(df: DataFrame, groups: list[str], value: str, parts: list[str] | None = None, fine: int = FINE) -> DataFrame:
    """The mergeable summary: per group, part and fixed section the number of rows and the smallest and largest value.

    Null and NaN values are left out. Null groups are groups. At most a few thousand rows per group and part.
    """
    v = F.col(value).cast("double")
    x = df.select(*groups, *(parts or []), v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    cell = F.floor(_scale(F.col("_v")) * fine).alias("section")
    return x.groupBy(*groups, *(parts or []), cell).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))


def combine(summary: DataFrame, groups: list[str]) -> DataFrame:
    """Summaries of several parts (days, sessions, runs) added up per group."""
    return summary.groupBy(*groups, "section").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _intervals(summary: DataFrame, groups: list[str], percentiles: tuple[float, ...]) -> DataFrame:
    """groups..., percentile, n_total, rank, share (weight of this rank), lo, hi, before, _n (its rows): the section of each target rank."""
    w = W.partitionBy(*groups)
    s = summary.withColumn("before", F.coalesce(F.sum("n").over(w.orderBy("section").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("n_total", F.sum("n").over(w))
    s = s.withColumn("percentile", F.explode(F.array(*[F.lit(float(p)) for p in percentiles]))).withColumn("_h", F.col("percentile") * (F.col("n_total") - 1))
    ends = F.array(F.struct(F.floor("_h").alias("rank"), (1 - F.col("_h") + F.floor("_h")).alias("share")), F.struct((F.floor("_h") + 1).alias("rank"), (F.col("_h") - F.floor("_h")).alias("share")))
    s = s.withColumn("_e", F.explode(F.filter(ends, lambda e: e["share"] > 0))).select("*", "_e.rank", "_e.share")
    return s.where("rank >= before and rank < before + n").select(*groups, "percentile", "n_total", "rank", "share", "lo", "hi", "before", F.col("n").alias("_n"))


def from_summary(summary: DataFrame, groups: list[str], percentiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Percentiles with bounds from a (combined) summary alone: n, value (middle of the bounds), lower and upper."""
    i = _intervals(summary, groups, percentiles)
    out = i.groupBy(*groups, "percentile").agg(F.max("n_total").alias("n"), F.sum(F.col("lo") * F.col("share")).alias("lower"), F.sum(F.col("hi") * F.col("share")).alias("upper"))
    return out.select(*groups, "percentile", "n", ((F.col("lower") + F.col("upper")) / 2).alias("value"), "lower", "upper")


def percentiles_by_bisection(
    df: DataFrame,
    groups: list[str],
    value: str,
    percentiles: tuple[float, ...] = (0.25, 0.5, 0.75),
    tolerance: float = 0.0,
    sections: int = 256,
    max_passes: int = 400,
    salt: int = 16,
    broadcast_rows: int = 20_000,
    keep_part: float = 0.2,
    summary: DataFrame | None = None,
) -> DataFrame:
    """groups..., percentile, n, value, lower, upper: percentiles interpolated linearly between the two nearest ranks.

    With ``tolerance`` 0 the bisection ends at the exact values (lower = upper = value); otherwise as soon as every
    interval is at most that wide. Null and NaN values are skipped, a group without values gives no row, null groups are
    groups, infinities are the smallest and largest values. Ties and repeated rows count each. Other columns are ignored.
    Empty input gives no rows. ``summary``: a combined summary of exactly these rows, to save the first pass.

    Scale: the first pass is one aggregate with map-side combine. A pass whose open intervals hold at most ``keep_part`` of
    all rows (their counts tell) writes these rows to the shared folder, and later passes count those; while the intervals
    hold more, as for values that lie close together, a pass only counts and so narrows them. Calling this runs the passes.
    Should ``max_passes`` not suffice, that is an error, never an inexact result: doubles need far fewer. Up to ``broadcast_rows`` open
    intervals are broadcast; beyond that the join of rows with the intervals of their group carries a salt, so that a group
    with a third of all rows is spread over ``salt`` tasks and more by adaptive execution.
    """
    ks = [f"_k{i}" for i in range(len(groups))]
    v = F.col(value).cast("double")
    x = df.select(*[F.col(g).alias(k) for g, k in zip(groups, ks)], v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    first = summary.select(*[F.col(g).alias(k) for g, k in zip(groups, ks)], "section", "n", "lo", "hi") if summary is not None else summarise(x, ks, "_v")
    state = materialise(_intervals(first, ks, percentiles), "bisect")
    is_open = (F.col("hi") > F.col("lo")) & (F.col("hi") - F.col("lo") > tolerance)
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in ks]
    rows = x.withColumn("_x", F.pmod(F.xxhash64("_v", F.monotonically_increasing_id()), F.lit(salt)).cast("int"))
    kept = False
    n_all = None
    for _ in range(max_passes):
        todo = state.where(is_open).groupBy(*ks, "lo", "hi").agg(F.max("_n").alias("_n"))
        n_open, n_inside = todo.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()  # two numbers
        if not n_open:
            break
        if n_all is None:
            n_all = first.agg(F.sum("n")).first()[0]
        todo = todo.drop("_n")
        within = F.col("r._v").between(F.col("s.lo"), F.col("s.hi"))
        if n_open <= broadcast_rows:
            inside = rows.alias("r").join(F.broadcast(todo).alias("s"), [*same("r", "s"), within])
        else:
            spans = todo.withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
            inside = rows.alias("r").join(spans.alias("s"), [*same("r", "s"), F.col("r._x") == F.col("s._x"), within])
        inside = inside.select(*[F.col(f"r.{k}") for k in ks], "r._v", "r._x", "s.lo", "s.hi")
        if not kept and n_inside <= keep_part * n_all:
            inside = materialise(inside, "bisect")
            rows, kept = inside.select(*ks, "_v", "_x"), True
        # midpoints: evenly spaced values, or evenly spaced on the log-like scale while an interval spans magnitudes
        wide = F.greatest(F.abs("lo"), F.abs("hi")) > 4 * F.least(F.abs("lo"), F.abs("hi")) + 1
        g, a, b = _scale(F.col("_v")), _scale(F.col("lo")), _scale(F.col("hi"))
        coarse = F.floor((g - a) / (b - a) * sections)
        even = F.floor((F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * sections)
        unbounded = (F.abs("lo") == float("inf")) | (F.abs("hi") == float("inf"))
        edge = F.when(F.col("_v") == F.col("lo"), 0).when(F.col("_v") == F.col("hi"), sections - 1)
        section = F.coalesce(edge, F.least(F.greatest(F.when((wide | unbounded) & (b > a), coarse).otherwise(even), F.lit(0)), F.lit(sections - 1))).cast("long")
        counted = inside.groupBy(*ks, "lo", "hi", section.alias("section")).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        below = F.coalesce(F.sum("n").over(W.partitionBy(*ks, "lo", "hi").orderBy("section").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        counted = counted.withColumn("_below", below)
        still = state.where(is_open)
        s, c = (F.broadcast(still) if n_open <= broadcast_rows else still.hint("merge")).alias("s"), counted.alias("c")
        at = F.col("s.rank") - F.col("s.before")
        narrowed = s.join(c, [*same("s", "c"), F.col("s.lo") == F.col("c.lo"), F.col("s.hi") == F.col("c.hi"), at >= F.col("c._below"), at < F.col("c._below") + F.col("c.n")])
        narrowed = narrowed.select(*[F.col(f"s.{k}") for k in ks], "s.percentile", "s.n_total", "s.rank", "s.share", F.col("c._lo").alias("lo"), F.col("c._hi").alias("hi"), (F.col("s.before") + F.col("c._below")).alias("before"), F.col("c.n").alias("_n"))
        state = materialise(state.where(~is_open).unionByName(narrowed), "bisect")
    else:
        raise RuntimeError("the target ranks are not resolved: raise max_passes")
    part = lambda c: F.sum(F.when(F.col("share") == 1, F.col(c)).otherwise(F.col(c) * F.col("share")))
    out = state.groupBy(*ks, "percentile").agg(F.max("n_total").alias("n"), part("lo").alias("lower"), part("hi").alias("upper"))
    value_ = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise((F.col("lower") + F.col("upper")) / 2)
    return out.select(*[F.col(k).alias(g) for k, g in zip(ks, groups)], "percentile", "n", value_.alias("value"), "lower", "upper")
