"""Per-key results where a few keys hold most rows.

Rows are first compressed to (key, value, frequency) by a hash aggregate with map-side combine, so a hot key arrives
once per distinct value and task, and its values are spread over all tasks. Results per key follow from the weighted
values: counts, distinct counts and modes are again combinable sums and maxima; exact percentiles first find the value
range of each wanted rank from counts per range, then look only into that range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.session import materialise


def compress(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys..., value, weight: how often each value occurs. NaN counts as null; null values keep a row of their own."""
    v = F.col(value)
    if dict(df.dtypes)[value] in ("double", "float"):
        v = F.when(~F.isnan(v), v)
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], v.alias("_v")).groupBy(*[f"_k{i}" for i in range(len(keys))], "_v").agg(F.count("*").alias("_w"))


def weighted_profile(df: DataFrame, keys: list[str], value: str, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75), ranges: int = 512) -> DataFrame:
    """Per key: n (rows), n_values (rows with a value), n_distinct, mode (smallest of the most frequent), share and p25, p50...

    ``share`` is the key's part of all rows of ``df``. Percentiles interpolate linearly between neighbouring ranks.
    Null and NaN values count in n only. Null keys are keys. A key without values has null mode and percentiles. ``value``
    must be a number. Empty input gives no rows. ``ranges`` is the number of value ranges per factor e of a key's spread:
    the largest task holds the distinct values of one key and range.

    Calling this runs the compression, the one pass over all rows, and writes the frequencies to the shared folder.
    """
    ks = [f"_k{i}" for i in range(len(keys))]
    freq = materialise(compress(df, keys, value), "frequencies")  # read three times below
    has = F.col("_v").isNotNull()
    best = F.max_by("_v", F.when(has, F.struct(F.col("_w"), -F.col("_v"))))
    key_rows = freq.groupBy(*ks).agg(
        F.sum("_w").alias("n"), F.sum(F.when(has, F.col("_w")).otherwise(0)).alias("n_values"), F.count("_v").alias("n_distinct"), best.alias("mode"),
        (F.sum(F.abs("_v") * F.col("_w")) / F.sum(F.when(has, F.col("_w")))).alias("_scale"),
    )
    per = key_rows.withColumn("share", F.col("n") / freq.agg(F.sum("_w")).scalar())
    # monotone ranges of a key's values; equal values share one
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    salted = freq.where(has).withColumn("_x", F.pmod(F.xxhash64("_v"), F.lit(16)).cast("int"))
    scales = per.select(*ks, "_scale").withColumn("_x", F.explode(F.sequence(F.lit(0), F.lit(15))))
    ranged = salted.alias("f").join(scales.alias("p"), same("f", "p", [*ks, "_x"])).select(*[F.col(f"f.{k}") for k in ks], "_v", "_w", F.coalesce(F.floor(F.asinh(F.try_divide(F.col("_v").cast("double"), F.col("_scale").cast("double"))) * ranges), F.lit(0)).alias("_g"))
    sizes = ranged.groupBy(*ks, "_g").agg(F.sum("_w").alias("_n"))
    upto = W.partitionBy(*ks).orderBy("_g").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).withColumn("_all", F.sum("_n").over(W.partitionBy(*ks)))
    qs = F.explode(F.array(*[F.lit(float(q)) for q in percentiles]))
    want = sizes.withColumn("_q", qs).withColumn("_h", F.col("_q") * (F.col("_all") - 1))
    want = want.withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_h"), F.ceil("_h"))))).where("_rank >= _before and _rank < _before + _n")
    inside = W.partitionBy(*ks, "_g").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    cum = ranged.withColumn("_c", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    w, c = want.alias("w"), cum.alias("c")
    hit = c.join(w, [*same("c", "w", ks), F.col("c._g") == F.col("w._g"), F.col("w._rank") - F.col("w._before") >= F.col("c._c"), F.col("w._rank") - F.col("w._before") < F.col("c._c") + F.col("c._w")])
    at = hit.select(*[F.col(f"c.{k}") for k in ks], "_q", (F.col("_h") - F.floor("_h")).alias("_part"), (F.col("_rank") == F.floor("_h")).alias("_low"), "_v")
    low, high = F.max(F.when(F.col("_low"), F.col("_v"))), F.max(F.when(~F.col("_low"), F.col("_v")))
    point = at.groupBy(*ks, "_q").agg((low + F.coalesce(high - low, F.lit(0.0)) * F.max("_part")).alias("_p"))
    names = [(float(q), "p" + f"{q * 100:g}".replace(".", "_")) for q in percentiles]
    wide = point.groupBy(*ks).agg(*[F.max(F.when(F.col("_q") == q, F.col("_p"))).alias(name) for q, name in names])
    out = per.alias("a").join(wide.alias("b"), same("a", "b", ks), "left")
    return out.select(*[F.col(f"a.{k}").alias(name) for k, name in zip(ks, keys)], "n", "n_values", "n_distinct", "mode", "share", *[name for _, name in names])


def heavy_keys(profile: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The keys of a profile, none of their parts null, that hold at least ``share`` of all rows."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return profile.where(known & (F.col("share") >= share)).select(*keys)
