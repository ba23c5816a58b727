"""Implausible readings, flagged per source against the source's normal behaviour.

A source is one value of ``source_cols``. Its readings in order of time pass through a local-level
Kalman filter whose measurement noise is the source's own noise. A standardised innovation above a
threshold withholds the update (the reading is a suspect); a run of readings whose innovations no
longer vary is stuck; a reading outside the physical range of its signal is impossible and never
enters the filter.

Scale: a source may be arbitrarily long. Readings get a global rank within their source by two cheap
steps (rank in a time bucket, plus a running count of the bucket sizes), and ranks are cut into blocks
of ``block`` readings with ``halo`` neighbours on each side. The filter forgets its start within a few
readings and every rule looks at fewer than ``halo`` readings around a run, so blocks are independent:
no task ever holds a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

#: Physical ranges of the signals: pixels, square pixels, degrees per second.
LIMITS = {
    "jaw_distance": (0.0, 1500.0),
    "nose_distance": (0.0, 1500.0),
    "top_nose_distance": (0.0, 1500.0),
    "pupil_area": (0.0, 20000.0),
    "whisker_velocity": (-6000.0, 6000.0),
}


@dataclass(frozen=True)
class SpikeRules:
    """What counts as implausible. ``sd`` below is the source's noise.

    ``gate``: standardised innovation beyond which an update is withheld. ``excursion_sd``: how far an
    excursion of at most ``excursion_max`` readings must leave the level before and after it. Innovations
    whose root mean square over ``vanish_over`` readings is at most ``vanish_sd`` sd have vanished;
    around them, ``stuck_min`` readings in a row that change by at most ``stuck_sd`` sd are stuck.
    ``process``: variance of the level's step as a part of the noise variance.
    """

    gate: float = 4.0
    excursion_sd: float = 9.0
    excursion_max: int = 3
    stuck_min: int = 12
    stuck_sd: float = 0.02
    vanish_sd: float = 0.1
    vanish_over: int = 3
    process: float = 0.5
    limits: dict = field(default_factory=lambda: dict(LIMITS))


def innovations(v: np.ndarray, sd: float, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Innovations, their z-scores, and the readings whose update was withheld in a run of at most ``excursion_max``.

    A run of withheld readings that grows beyond that is a movement or a new level: the filter restarts there and the run
    is released. A run that the end of the series cuts off stays withheld.
    """
    r, q, gate, keep = sd * sd, rules.process * sd * sd, rules.gate, rules.excursion_max
    level, p = float(np.median(v[: 2 * keep + 3])), r
    e_all, z_all = [0.0] * len(v), [0.0] * len(v)
    run: list[int] = []
    held: list[int] = []
    for i, x in enumerate(v.tolist()):
        ahead = p + q
        s = ahead + r
        e = x - level
        z = e / s**0.5
        e_all[i], z_all[i] = e, z
        if -gate <= z <= gate:
            k = ahead / s
            level += k * e
            p = (1.0 - k) * ahead
            if run:
                held += run
                run = []
        else:
            run.append(i)
            if len(run) > keep:
                level, p, run = x, r, []
    out = np.zeros(len(v), bool)
    out[np.array(held + run, dtype=int)] = True
    return np.array(e_all), np.array(z_all), out


def filter_block(value: np.ndarray, impossible: np.ndarray, sd: float, rules: SpikeRules) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Innovation z-scores (forecast from the past), spikes and stuck readings of a block in order of time.

    Impossible readings are stepped over. The filter runs forward and backward. A spike is a reading withheld in both
    directions, in a run of at most ``excursion_max``, whose innovations leave the level forecast from before and the one
    forecast from behind to the same side by more than ``excursion_sd`` sd. Stuck readings are where the innovations' variance vanishes
    (``stuck_runs``).
    """
    n = len(value)
    z, spike = np.full(n, np.nan), np.zeros(n, bool)
    good = np.flatnonzero(~impossible)
    vanished = np.zeros(n, bool)
    if len(good):
        v = value[good]
        if sd > 0:
            e, zs, held = innovations(v, sd, rules)
            eb, _, held_b = (a[::-1] for a in innovations(v[::-1], sd, rules))
            z[good] = zs
            vanished[good] = _vanishing(e, sd, rules) | _vanishing(eb[::-1], sd, rules)[::-1]
            far = rules.excursion_sd * sd
            spike[good] = held & held_b & (((e > far) & (eb > far)) | ((e < -far) & (eb < -far)))
        else:  # no noise at all: the level is the last reading
            vanished[good[1:]] = np.diff(v) == 0
    stuck = stuck_runs(value, impossible, vanished, sd, rules)
    return z, spike & ~stuck, stuck


def _vanishing(e: np.ndarray, sd: float, rules: SpikeRules) -> np.ndarray:
    """Where the mean square of the last ``vanish_over`` innovations is at most that of ``vanish_sd`` sd."""
    w = rules.vanish_over
    out = np.zeros(len(e), bool)
    if len(e) >= w:
        out[w - 1 :] = np.sqrt(np.lib.stride_tricks.sliding_window_view(e * e, w).mean(axis=1)) <= rules.vanish_sd * sd
    return out


def stuck_runs(value: np.ndarray, impossible: np.ndarray, vanished: np.ndarray, sd: float, rules: SpikeRules) -> np.ndarray:
    """The exact check of vanished innovations: runs of at least ``stuck_min`` readings around them that practically repeat each other.

    A run that straddles the border to impossible readings, which the filter does not see, is looked at too.
    """
    stuck = np.zeros(len(value), bool)
    near = np.abs(np.diff(value)) <= rules.stuck_sd * sd
    look = vanished | impossible
    edge = np.flatnonzero(np.diff(np.concatenate(([0], near.view(np.int8), [0]))))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a + 1 >= rules.stuck_min and look[a : b + 1].any():
            stuck[a : b + 1] = True
    return stuck


_OUT = "rank long, sd double, z double, impossible boolean, stuck boolean, spike boolean"


def flag_readings(
    df: DataFrame,
    source_cols: tuple[str, ...] = ("session_id", "signal"),
    signal_col: str = "signal",
    id_col: str = "sample_id",
    time_col: str = "t",
    value_col: str = "value",
    rules: SpikeRules = SpikeRules(),
    bucket_seconds: float = 240.0,
    block: int = 16384,
    halo: int = 64,
) -> DataFrame:
    """One row per reading with a time and a value: ids, rank in its source, noise, z and the three flags.

    Null and NaN values and null times are skipped (no row). Exact duplicate rows count once. Equal times
    are ordered by the id. A null in a source column is a source of its own. Other columns of ``df`` are
    ignored, whatever their names. An empty input gives an empty result. A source whose readings never
    change has no noise: only the range rule and the stuck rule apply to it.

    The ranked readings are cached (memory, then disk), as noise, sizes and blocks come from them; clear the session's cache
    when the result has been used.
    """
    keys = [f"_s{i}" for i in range(len(source_cols))]
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c))
    base = df.select(
        *[F.col(c).alias(k) for c, k in zip(source_cols, keys)],
        F.col(signal_col).alias("_g"),
        F.col(id_col).alias("_id"),
        F.col(time_col).cast("double").alias("_t"),
        F.col(value_col).cast("double").alias("_v"),
    ).where(fine("_t") & fine("_v"))
    low = F.lit(None).cast("double")
    high = F.lit(None).cast("double")
    for g, (a, b) in rules.limits.items():
        low, high = F.when(F.col("_g") == g, F.lit(a)).otherwise(low), F.when(F.col("_g") == g, F.lit(b)).otherwise(high)
    base = base.withColumn("_bad", F.coalesce((F.col("_v") < low) | (F.col("_v") > high), F.lit(False))).drop("_g")
    base = base.withColumn("_b", F.floor(F.col("_t") / F.lit(bucket_seconds)))
    # exact repeats go before the ranks are given, without a shuffle of their own
    base = base.repartition(*keys, "_b").dropDuplicates([*keys, "_b", "_t", "_id", "_v", "_bad"])
    inside = W.partitionBy(*keys, "_b").orderBy("_t", "_id", "_v")
    ranked = base.withColumn("_rn", F.row_number().over(inside)).withColumn("_d", F.when(~F.col("_bad") & ~F.lag("_bad").over(inside), F.abs(F.col("_v") - F.lag("_v").over(inside))))
    ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)

    # noise: of the first differences, without repeats (stuck stretches and coarse steps of zero). Successive noise
    # is correlated, so differences are narrower than the noise itself; 1.4 is their usual ratio for first-order noise.
    noise = ranked.where(F.col("_d") > 0).groupBy(*keys).agg((F.percentile_approx("_d", 0.5, 2000) * (1.4 / (0.6744897501960817 * 2**0.5))).alias("_sd"))
    sizes = ranked.groupBy(*keys, "_b").agg(F.max("_rn").cast("long").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy(*keys)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_all", F.sum("_n").over(total)).drop("_n")
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    sizes = sizes.alias("a").join(noise.alias("b"), same("a", "b", keys), "left").select("a.*", "b._sd")
    placed = ranked.alias("r").join(sizes.alias("s"), same("r", "s", [*keys, "_b"]), "inner")
    placed = placed.select(*[f"r.{k}" for k in keys], "r._id", "r._v", "r._bad", (F.col("s._off") + F.col("r._rn") - 1).alias("_r"), "s._all", "s._sd")
    last = F.floor((F.col("_all") - 1) / block)
    first_block = F.greatest(F.floor((F.col("_r") - halo) / block), F.lit(0))
    last_block = F.least(F.floor((F.col("_r") + halo) / block), last)
    cut = placed.withColumn("_k", F.explode(F.sequence(first_block, last_block))).drop("_all")

    names = list(source_cols)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in names] + [T.StructField(id_col, df.schema[id_col].dataType)] + T._parse_datatype_string(_OUT).fields)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r", kind="stable")
        k = int(pdf["_k"].iloc[0])
        v = pdf["_v"].to_numpy(float)
        bad = pdf["_bad"].to_numpy(bool)
        sd = float(pdf["_sd"].iloc[0]) if pdf["_sd"].notna().iloc[0] else 0.0
        z, spike, stuck = filter_block(v, bad, sd, rules)
        rank = pdf["_r"].to_numpy()
        own = (rank // block) == k
        out = {c: pdf[kk].to_numpy()[own] for c, kk in zip(names, keys)}
        out |= {id_col: pdf["_id"].to_numpy()[own], "rank": rank[own], "sd": np.full(int(own.sum()), sd), "z": z[own], "impossible": bad[own], "stuck": stuck[own], "spike": spike[own]}
        return pd.DataFrame(out)

    return cut.groupBy(*keys, "_k").applyInPandas(kernel, schema)


def implausible(flags: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """The ids of all flagged readings."""
    return flags.where("impossible or stuck or spike").select(id_col)
