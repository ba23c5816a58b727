"""Encoding models over trials and time bins: event kernels, analog and scalar predictors, ridge fits of all units of a session.

The design has one row per trial and bin and is the same for all units of a session, so it is built once, in the JVM, and
each fit works on the sums X'X (once per fold) and X'Y (for a block of units at once). Spike counts reach the kernel as they
are counted, without their zeros. A task holds the design of one session and the counts of one block of its units.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.operators.interval import micros, range_join


@dataclass(frozen=True)
class Bins:
    """``n`` bins of ``width`` microseconds from ``start`` after each trial's time."""

    start: int = -1_000_000
    width: int = 100_000
    n: int = 30


#: Reach of an event's kernel in bins: a column per shift from ``-before`` to ``after - 1``.
KERNELS = {"whisker_stim": (0, 3), "auditory_stim": (0, 3), "jaw_onset": (5, 0)}


def kernel_columns(kernels: dict[str, tuple[int, int]]) -> list[str]:
    return [f"{name}_{'m' if s < 0 else 'p'}{abs(s)}" for name, (before, after) in kernels.items() for s in range(-before, after)]


def design_matrix(trials: DataFrame, keys: list[str], event: str, at: str, times: dict[str, str], scalars: list[str], kernels: dict[str, tuple[int, int]] = KERNELS, bins: Bins = Bins(), samples: DataFrame | None = None, signals: list[str] | None = None) -> DataFrame:
    """keys, event, bin, offset and one column per predictor: one row per trial and bin.

    ``times`` names for each kernel the column with the event's time (microseconds; null: no such event in the trial). A kernel's
    column of shift s is 1 in the bin s bins after that of the event, 0 elsewhere; an event outside the window has no effect, and
    nothing reaches across trials. ``scalars`` are columns of ``trials``, the same in all bins; null counts as 0. ``samples`` (keys,
    signal, t_us, value) give a column per signal: the mean in each bin, 0 where there is none.
    """
    t = trials.select(*keys, event, F.col(at).alias("_at"), *[F.col(c).alias(f"_t_{k}") for k, c in times.items()], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in scalars])
    x = t.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins.n - 1))))
    cols = [F.lit(1.0).alias("offset"), *[F.col(c) for c in scalars]]
    for name, (before, after) in kernels.items():
        own = F.floor((F.col(f"_t_{name}") - F.col("_at") - bins.start) / F.lit(bins.width))
        for s, c in zip(range(-before, after), kernel_columns({name: (before, after)})):
            cols.append(F.when(own.between(0, bins.n - 1) & (F.col("bin") == own + s), 1.0).otherwise(0.0).alias(c))
    x = x.select(*keys, event, "bin", *cols)
    if samples is not None and signals:
        near = range_join(samples, t.select(*keys, event, F.col("_at").alias("at_us")), keys, bins.start, bins.start + bins.n * bins.width)
        at_bin = F.floor((F.col("t_us") - F.col("at_us") - bins.start) / F.lit(bins.width)).cast("int").alias("bin")
        m = near.where(F.col("signal").isin(signals)).groupBy(*keys, event, at_bin).agg(*[F.avg(F.when(F.col("signal") == g, F.col("value"))).alias(g) for g in signals])
        x = x.join(m, [*keys, event, "bin"], "left").fillna(0.0, signals)
    return x


def groups_of(columns: list[str], prefixes: tuple[str, ...]) -> dict[str, list[str]]:
    """Reduced models: for each prefix the columns without those that begin with it."""
    return {f"no_{p}": [c for c in columns if not c.startswith(p)] for p in prefixes}


def ridge_all(x: np.ndarray, y: np.ndarray, lam: np.ndarray) -> np.ndarray:
    """Weights (features x units) of ridge fits without intercept, each unit (column of ``y``) with its own penalty."""
    a, b = x.T @ x, x.T @ y
    w = np.zeros((x.shape[1], y.shape[1]))
    for v in np.unique(lam):
        at = lam == v
        w[:, at] = np.linalg.solve(a + v * np.eye(len(a)), b[:, at])
    return w


def r2(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """R squared per column; NaN for a constant one."""
    s = ((y - y.mean(axis=0)) ** 2).sum(axis=0)
    return np.where(s > 0, 1 - ((y - mu) ** 2).sum(axis=0) / np.where(s > 0, s, 1), np.nan)


def columns_r(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    a, b = y - y.mean(axis=0), mu - mu.mean(axis=0)
    d = np.sqrt((a * a).sum(axis=0) * (b * b).sum(axis=0))
    return np.where(d > 1e-12, (a * b).sum(axis=0) / np.where(d > 1e-12, d, 1), np.nan)


def bits(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Bits per event against a constant rate, per column; NaN without events."""
    n, m = y.sum(axis=0), np.maximum(mu, 1e-12)
    flat = np.maximum(y.mean(axis=0), 1e-300)
    gain = (y * np.log(m) - m).sum(axis=0) - (n * np.log(flat) - len(y) * flat)
    return np.where(n > 0, gain / np.where(n > 0, n, 1) / np.log(2), np.nan)


#: Penalties tried: ten, evenly spaced in the logarithm.
LAMBDAS = tuple(float(v) for v in np.exp(np.linspace(np.log(10), np.log(1e-5), 10)))


def fit_binned(design: DataFrame, counts: DataFrame, units: DataFrame, key: str, unit: str, event: str, fold: str, models: dict[str, list[str]], scaled: tuple[str, ...] = (), masks: dict[str, dict[str, tuple[int, ...]]] | None = None, lambdas: tuple[float, ...] = LAMBDAS, inner: int = 5, block: int = 64) -> DataFrame:
    """key, unit, fold, model_name, predictors, lambda_opt, train_score, test_score, train_corr, test_corr, train_mi, test_mi, coef.

    ``design``: key, event, bin, ``fold`` and the predictors; ``counts``: key, unit, event, bin, n (> 0 only; what is missing is 0);
    ``units``: key, unit. The first of ``models`` is the full one: its penalty is chosen per unit and fold by ``inner``-fold
    cross-validation over trials (R squared), and the others are fitted with it. ``scaled`` columns are standardised on the training
    rows. ``masks``: per model, columns kept only in the given bins and 0 elsewhere. Scores are R squared, Pearson r and
    bits per event, null where a unit has a constant count or none. A fold with fewer training rows than predictors, or without test rows, gives no rows.
    """
    masks = masks or {}
    every = list(dict.fromkeys(c for cols in models.values() for c in cols))
    kinds = dict(units.dtypes)
    numbered = units.select(key, unit).distinct().withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(unit)) - 1)
    blocks = numbered.select(key, unit, F.floor(F.col("_r") / block).cast("int").alias("_b"))
    per_key = blocks.select(key, F.col("_b").alias("_bx")).distinct()
    x = design.select(key, event, "bin", fold, F.array(*[F.col(c).cast("double") for c in every]).alias("_x")).join(per_key, key)
    y = counts.select(key, unit, event, "bin", F.col("n").cast("double").alias("_n")).join(blocks, [key, unit])
    y = y.select(key, "_b", unit, event, "bin", "_n")
    none = [F.lit(None).cast(y.schema[c].dataType).alias(c) for c in (event, "bin", "_n")]
    y = y.unionByName(blocks.select(key, "_b", unit, *none))  # units without spikes are units too
    schema = f"`{key}` {kinds[key]}, `{unit}` {kinds[unit]}, fold long, model_name string, predictors array<string>, lambda_opt double, train_score double, test_score double, train_corr double, test_corr double, train_mi double, test_mi double, coef array<double>"
    names = [c.split()[0].strip("`") for c in schema.split(", ")]

    def fit(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        if not len(xs) or not len(ys):
            return pd.DataFrame(columns=names)
        xs = xs.sort_values([event, "bin"], ignore_index=True)
        who = np.sort(ys[unit].unique())
        row = pd.Series(np.arange(len(xs)), index=pd.MultiIndex.from_arrays([xs[event], xs["bin"]]))
        hit = ys.dropna(subset=["_n"])
        at = row.reindex(pd.MultiIndex.from_arrays([hit[event].astype(xs[event].dtype), hit["bin"].astype(xs["bin"].dtype)])).to_numpy()
        good = ~np.isnan(at)
        yy = np.zeros((len(xs), len(who)))
        np.add.at(yy, (at[good].astype(int), np.searchsorted(who, hit[unit].to_numpy()[good])), hit["_n"].to_numpy()[good])
        big, bin_, fo = np.stack(xs["_x"].to_numpy()), xs["bin"].to_numpy(), xs[fold].to_numpy()
        trial = pd.factorize(xs[event])[0]
        out = []
        for f in np.unique(fo):
            tr, te = fo != f, fo == f
            if tr.sum() <= len(every) or te.sum() < 2:
                continue
            z = big.copy()
            for c in scaled:
                j = every.index(c)
                s = z[tr, j].std()
                z[:, j] = (z[:, j] - z[tr, j].mean()) / (s if s > 0 else 1)
            lam = None
            for name, cols in models.items():
                use = z[:, [every.index(c) for c in cols]]
                for c, kept in masks.get(name, {}).items():
                    use[~np.isin(bin_, kept), cols.index(c)] = 0.0
                if lam is None:
                    part = trial % inner
                    scores = np.zeros((len(lambdas), yy.shape[1]))
                    for p in range(inner):
                        a, b = tr & (part != p), tr & (part == p)
                        if not b.any() or not a.any():
                            continue
                        xx, xy = use[a].T @ use[a], use[a].T @ yy[a]
                        for i, v in enumerate(lambdas):
                            scores[i] += np.nan_to_num(r2(yy[b], use[b] @ np.linalg.solve(xx + v * np.eye(len(xx)), xy)))
                    lam = np.asarray(lambdas)[scores.argmax(axis=0)]
                w = ridge_all(use[tr], yy[tr], lam)
                mu = use @ w
                cells = [r2(yy[tr], mu[tr]), r2(yy[te], mu[te]), columns_r(yy[tr], mu[tr]), columns_r(yy[te], mu[te]), bits(yy[tr], mu[tr]), bits(yy[te], mu[te])]
                for u in range(len(who)):
                    out.append((xs[key].iat[0], who[u], int(f), name, cols, float(lam[u]), *[float(c[u]) for c in cells], w[:, u].tolist()))
        return pd.DataFrame(out, columns=names)

    return x.groupBy(key, "_bx").cogroup(y.groupBy(key, "_b")).applyInPandas(fit, schema)


def binned_counts(spikes: DataFrame, trials: DataFrame, keys: list[str], unit: str, event: str, bins: Bins = Bins()) -> DataFrame:
    """keys, unit, event, bin, n: spikes per trial and bin, where there are any. ``trials`` has ``at_us``."""
    near = range_join(spikes, trials.select(*keys, event, "at_us"), keys, bins.start, bins.start + bins.n * bins.width)
    return near.groupBy(*keys, unit, event, F.floor((F.col("t_us") - F.col("at_us") - bins.start) / F.lit(bins.width)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


__all__ = ["Bins", "KERNELS", "LAMBDAS", "binned_counts", "design_matrix", "fit_binned", "groups_of", "kernel_columns", "micros"]
