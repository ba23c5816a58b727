"""Resampling tests over one series per unit: linear shifts, shuffled lags and permuted labels.

A unit's series (as long as its session has trials) is gathered into arrays and tested by a small NumPy kernel, with all
repetitions at once; rows are never multiplied by repetitions in a shuffle. Draws are those of ``resample.draw``: they depend
on (seed, repetition, key) only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.operators.resample import A, B, C, P

TINY = 1e-9


def draws(key: np.ndarray, rep: np.ndarray, seed: int = 1) -> np.ndarray:
    """``resample.draw`` for arrays of whole numbers."""
    x = (np.asarray(key, np.int64) * A + np.asarray(rep, np.int64) * B + seed * C) % P
    return (x * x + x * A + rep) % P


def mixed(key: np.ndarray, rep: np.ndarray, seed: int = 1) -> np.ndarray:
    """64 evenly mixed bits (splitmix64) of (seed, repetition, key). Within a repetition ``draws`` of evenly spaced keys depend on
    each other, so that some pairs are drawn together too often; these do not."""

    def mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    step = np.uint64(0x9E3779B97F4A7C15)
    key, rep = (np.atleast_1d(np.asarray(v, np.int64)).astype(np.uint64) for v in (key, rep))
    return mix(mix(mix(rep * step) + np.uint64(seed)) + key * step)


def gather(df: DataFrame, by: list[str], index: str, cols: list[str]) -> DataFrame:
    """by..., _i, _0, _1, ...: the index and each of ``cols`` as arrays in order of the index. Rows with a null index are left out."""
    s = F.array_sort(F.collect_list(F.struct(F.col(index).cast("long").alias("i"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])))
    g = df.where(F.col(index).isNotNull()).groupBy(*by).agg(s.alias("_s"))
    part = lambda name: F.transform("_s", lambda x: x[name])
    return g.select(*by, part("i").alias("_i"), *[part(f"c{k}").alias(f"_{k}") for k in range(len(cols))])


def per_series(series: DataFrame, by: list[str], kernel: Callable[..., dict | None], out: str) -> DataFrame:
    """``kernel(row)`` for every row of ``gather``: a dict of equally long columns (``out``), or None for no row."""
    names = [c.strip().split()[0] for c in out.split(",")]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in series.select(*by).schema)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            at: list[int] = []
            parts: dict[str, list] = {c: [] for c in names}
            for i, row in enumerate(pdf.itertuples(index=False, name=None)):
                got = kernel(dict(zip(pdf.columns, row)))
                if got is not None:
                    at += [i] * len(got[names[0]])
                    for c in names:
                        parts[c].extend(got[c])
            out = pdf.iloc[at][by].reset_index(drop=True)
            yield out.assign(**parts)[[*by, *names]]

    return series.mapInPandas(work, f"{types}, {out}")


def pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """r of each row of ``x`` with ``y``; NaN for a constant."""
    a, b = x - x.mean(axis=1, keepdims=True), y - y.mean()
    s, t = np.sqrt((a * a).mean(axis=1)), np.sqrt((b * b).mean())
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((s > TINY) & (t > TINY), (a @ b) / len(y) / (s * t), np.nan)


def midranks(v: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties sharing their mean."""
    _, at, n = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def spearman(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return pearson(np.stack([midranks(r) for r in x]), midranks(y))


SCORES = {"pearson": pearson, "spearman": spearman}


def shift_test(
    df: DataFrame, by: list[str], index: str, x: str, y: str, n: int = 39, least_rows: int = 8, score: str | Callable = "pearson", given: str | None = None, alternative: str = "two-sided",
) -> DataFrame:
    """Linear-shift test per ``by``: n_rows, n_shifts, r (score at shift 0), m, p_conservative = m / (n + 1), p_approx = m / (2n + 1).

    ``x`` at shifts -n..n against the central rows of ``y`` (n left out at each end). ``m`` counts the shifts whose score is
    at least as extreme as that at shift 0, itself included: by size (``two-sided``), ``greater`` or ``less``. ``score`` is
    ``pearson``, ``spearman`` or a function of (matrix of shifted x, y) that returns one score per row. ``given``: a third
    series whose linear share is taken out of both (partial correlation). A series too short for ``n`` takes the most shifts that leave
    ``least_rows`` central rows; one too short for a single shift has n_shifts 0, r null and p 1, as has a constant one. Rows
    where one of the series is null are left out.
    """
    f = SCORES[score] if isinstance(score, str) else score
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(given).isNotNull() if given else F.lit(True)))
    most = n

    def kernel(row: dict) -> dict:
        a, b = np.asarray(row["_0"], float), np.asarray(row["_1"], float)
        k = min(most, (len(a) - least_rows) // 2)
        if k < 1:
            return {"n_rows": [len(a)], "n_shifts": [0], "r": [np.nan], "m": [0], "p_conservative": [1.0], "p_approx": [1.0]}
        c = len(a) - 2 * k
        xs, ys = np.lib.stride_tricks.sliding_window_view(a, c), b[k : k + c]
        if given:
            z = np.asarray(row["_2"], float)[k : k + c]
            z = z - z.mean()
            zz = float(z @ z)
            if zz > TINY:
                xs, ys = xs - np.outer((xs - xs.mean(axis=1, keepdims=True)) @ z / zz, z), ys - ((ys - ys.mean()) @ z / zz) * z
        r = f(xs, ys)
        own = r[k]
        if np.isnan(own):
            return {"n_rows": [c], "n_shifts": [k], "r": [np.nan], "m": [0], "p_conservative": [1.0], "p_approx": [1.0]}
        with np.errstate(invalid="ignore"):
            far = {"two-sided": np.abs(r) >= abs(own) - TINY, "greater": r >= own - TINY, "less": r <= own + TINY}[alternative]
        m = int(far.sum())
        return {"n_rows": [c], "n_shifts": [k], "r": [own], "m": [m], "p_conservative": [min(1.0, m / (k + 1))], "p_approx": [m / (2 * k + 1)]}

    s = gather(known, by, index, [x, y] + ([given] if given else []))
    return per_series(s, by, kernel, "n_rows long, n_shifts long, r double, m long, p_conservative double, p_approx double")


def subset_means(df: DataFrame, pool: str, group: str, key: str, ties: list[str], value: str, n: int, block: int = 100) -> DataFrame:
    """pool, group, n, m, z, p: a group's mean against the means of as many rows drawn without replacement from its pool, ``n`` times.

    Repetition r draws the first rows of the pool in the order of ``draws(key, r)``, then key and ``ties``; one order serves all groups.
    ``z``: m less the mean of the drawn means, in their population deviations (null below 1e-12); ``p``: draws at least as far
    from 0, and one, of n + 1. Null values count as rows but in no mean. A task orders one pool ``block`` times; nothing is
    multiplied by repetitions in a shuffle.
    """
    w = W.partitionBy(pool, group)
    x = df.select(F.col(pool).alias("_pool"), F.col(group).alias("_group"), F.col(key).cast("long").alias("_k"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)], F.col(value).cast("double").alias("_v"), F.count("*").over(w).cast("long").alias("_n"), F.avg(value).over(w).alias("_m"))
    x = x.withColumn("_from", F.explode(F.array(*[F.lit(r) for r in range(1, n + 1, block)])))
    order = ["_k", *[f"_t{i}" for i in range(len(ties))]]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        k, v = pdf["_k"].to_numpy(), pdf["_v"].to_numpy(float)
        known = ~np.isnan(v)
        v = np.where(known, v, 0.0)
        g = pdf[["_pool", "_group", "_n", "_m"]].drop_duplicates(["_group"])
        at, m = g["_n"].to_numpy() - 1, g["_m"].to_numpy(float)
        c, s, q, far = np.zeros((4, len(g)))
        first = int(pdf["_from"].iat[0])
        for rep in range(first, min(first + block, n + 1)):
            o = np.argsort(draws(k, rep), kind="stable")
            total, count = np.cumsum(v[o])[at], np.cumsum(known[o])[at]
            has = count > 0
            mean = np.divide(total, count, out=np.zeros(len(g)), where=has)
            d = np.where(has, mean - m, 0.0)
            c, s, q, far = c + has, s + d, q + d * d, far + (has & (np.abs(mean) >= np.abs(m)))
        return g.assign(_c=c, _s=s, _q=q, _far=far)

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    parts = x.groupBy("_pool", "_from").applyInPandas(kernel, f"_pool {types[pool]}, _group {types[group]}, _n long, _m double, _c double, _s double, _q double, _far double")
    t = parts.groupBy("_pool", "_group", "_n", "_m").agg(*[F.sum(c).alias(c) for c in ("_c", "_s", "_q", "_far")])
    off = F.try_divide(F.col("_s"), F.col("_c"))
    sd = F.sqrt(F.greatest(F.try_divide(F.col("_q"), F.col("_c")) - off * off, F.lit(0.0)))
    return t.select(F.col("_pool").alias(pool), F.col("_group").alias(group), F.col("_n").alias("n"), F.col("_m").alias("m"), F.try_divide(-off, F.when(sd > 1e-12, sd)).alias("z"), ((F.col("_far") + 1) / F.lit(n + 1.0)).alias("p"))


def region_encoding(
    cells: DataFrame, by: list[str], region: str, entity: str, baseline: float = 0.05, n_boot: int = 5000, n_perm: int = 10_000, least: int = 2, block: int = 1000, size: int = 2_000_000, alpha: float = 0.05,
) -> DataFrame:
    """by..., region, n_mice, n_neurons, n_significant, observed_proportion, bootstrap_mean, bootstrap_se, ci_lower, ci_upper, n_boot,
    perm_null_mean, perm_null_std, z, p, n_perm, exceeds_baseline, ci_excludes_baseline, p_adj, encodes: does a region respond above chance?

    ``cells``: by, region, entity (whole numbers), k (significant), known (neurons with an outcome), n (all neurons), one row each. Regions
    with fewer than ``least`` entities are not tested; rows without a region count in the null distribution of their ``by`` alone.

    Interval: the region's entities are drawn with replacement, repeats counted once; mean of the proportions and 1.96 of their
    population deviations. Null distribution: as many entities of the whole ``by``, drawn without replacement, with all their
    neurons; ``p`` is the part of it at least as high as the region, ``z`` is null without spread. Draws without a known outcome
    count in neither (n_boot, n_perm are those that count). ``p_adj``: Benjamini-Hochberg per ``by``; encodes if below ``alpha``.
    Draws are ``mixed``, of (repetition, place in the region) and (repetition, entity). A task draws for regions, or orders the
    entities of a ``by`` ``block`` times. Calling this computes the cells and the tests, and writes both to the shared folder.
    """
    from axonlake.operators import stats
    from axonlake.session import materialise

    cells = materialise(cells, "cells")
    tasks = 4 * cells.sparkSession.sparkContext.defaultParallelism

    def interval(row: dict) -> dict:
        k, known = np.asarray(row["_0"]), np.asarray(row["_1"])
        m, step = len(k), max(1, size // len(k))
        i, got = np.arange(1, m + 1), []
        for a in range(1, n_boot + 1, step):
            rep = np.arange(a, min(n_boot, a + step - 1) + 1)
            inside = np.zeros((len(rep), m))
            u = (mixed(i[None, :], rep[:, None]) >> np.uint64(11)) * 2.0**-53
            np.put_along_axis(inside, (u * m).astype(np.int64), 1.0, axis=1)
            total = inside @ known
            got.append((inside @ k)[total > 0] / total[total > 0])
        x = np.concatenate(got)
        return {"n_boot": [len(x)], "bootstrap_mean": [x.mean() if len(x) else None], "bootstrap_se": [x.std() if len(x) else None]}

    def null(row: dict) -> dict:
        i, k, known = np.asarray(row["_i"]), np.asarray(row["_0"]), np.asarray(row["_1"])
        at, own = np.asarray(row["_size"]) - 1, np.asarray(row["_own"], float)
        c, s, q, high = np.zeros((4, len(at)))
        mid = k.sum() / known.sum()  # sums of differences from it are exact without spread
        last, step = min(n_perm, int(row["_from"]) + block - 1), max(1, size // len(i))
        for a in range(int(row["_from"]), last + 1, step):
            rep = np.arange(a, min(last, a + step - 1) + 1)
            order = np.argsort(mixed(i[None, :], rep[:, None], 2), axis=1, kind="stable")
            total = np.cumsum(known[order], axis=1)[:, at]
            has = total > 0
            x = np.divide(np.cumsum(k[order], axis=1)[:, at], total, out=np.zeros(total.shape), where=has)
            d = np.where(has, x - mid, 0.0)
            c, s, q, high = c + has.sum(axis=0), s + d.sum(axis=0), q + (d * d).sum(axis=0), high + (has & (x >= own)).sum(axis=0)
        return {"_region": row["_regions"], "_mid": np.full(len(at), mid), "_c": c, "_s": s, "_q": q, "_high": high}

    regions = cells.where(F.col(region).isNotNull())
    tested = regions.groupBy(*by, region).agg(F.count("*").alias("n_mice"), F.sum("n").alias("n_neurons"), F.sum("k").alias("n_significant"), F.try_divide(F.sum("k"), F.sum("known")).alias("observed_proportion")).where(F.col("n_mice") >= least)
    boot = gather(regions, [*by, region], entity, ["k", "known"]).where(F.size("_i") >= least).repartition(tasks, *by, region)
    boot = per_series(boot, [*by, region], interval, "n_boot long, bootstrap_mean double, bootstrap_se double")

    listed = tested.where("observed_proportion is not null").groupBy(*by).agg(F.collect_list(F.struct(F.col(region).alias("a"), F.col("n_mice").alias("m"), F.col("observed_proportion").alias("o"))).alias("_t"))
    listed = listed.select(*by, F.col("_t.a").alias("_regions"), F.col("_t.m").alias("_size"), F.col("_t.o").alias("_own"))
    whole = gather(cells.groupBy(*by, entity).agg(F.sum("k").alias("k"), F.sum("known").alias("known")), by, entity, ["k", "known"])
    pools = whole.join(listed, by).withColumn("_from", F.explode(F.array(*[F.lit(r) for r in range(1, n_perm + 1, block)]))).repartition(tasks, *by, "_from")
    kind = cells.schema[region].dataType.simpleString()
    parts = per_series(pools, by, null, f"_region {kind}, _mid double, _c double, _s double, _q double, _high double")
    t = parts.groupBy(*by, F.col("_region").alias(region)).agg(F.max("_mid").alias("_mid"), *[F.sum(c).alias(c) for c in ("_c", "_s", "_q", "_high")])

    own, mean, se = F.col("observed_proportion"), F.col("bootstrap_mean"), F.col("bootstrap_se")
    off = F.try_divide(F.col("_s"), F.col("_c"))
    sd = F.sqrt(F.greatest(F.try_divide(F.col("_q"), F.col("_c")) - off * off, F.lit(0.0)))
    x = tested.join(boot, [*by, region]).join(t, [*by, region], "left").select(
        *by, region, "n_mice", "n_neurons", "n_significant", "observed_proportion", "bootstrap_mean", "bootstrap_se", (mean - 1.96 * se).alias("ci_lower"), (mean + 1.96 * se).alias("ci_upper"), "n_boot",
        (F.col("_mid") + off).alias("perm_null_mean"), sd.alias("perm_null_std"), F.try_divide(own - F.col("_mid") - off, sd).alias("z"), F.try_divide(F.col("_high"), F.col("_c")).alias("p"), F.coalesce(F.col("_c"), F.lit(0)).cast("long").alias("n_perm"),
        F.coalesce(own > baseline, F.lit(False)).alias("exceeds_baseline"), F.coalesce(mean - 1.96 * se > baseline, F.lit(False)).alias("ci_excludes_baseline"),
    )
    return stats.fdr(x, by, "p").drop("reject").withColumn("encodes", F.coalesce(F.col("p_adj") < alpha, F.lit(False)))


def lag_shuffles(df: DataFrame, by: list[str], index: str, x: str, y: str, max_lag: int = 10, n: int = 1000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """by..., lag, r, n_rep, p_pos, p_neg, p, significant: cross-correlation at lags -max..max (sum of z_x(i + lag) z_y(i) over
    N, zero beyond the ends) against ``n`` shuffles of ``y``.

    ``p_pos`` and ``p_neg`` are the parts of the shuffles at least as high and as low. A lag is significant if one of them is
    below alpha / 2; ``p`` is that one, else ``p_pos``. A constant series gives no rows. Rows with a null are left out.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def kernel(row: dict) -> dict | None:
        a, b, i = np.asarray(row["_0"], float), np.asarray(row["_1"], float), np.asarray(row["_i"], np.int64)
        size = len(a)
        if size < 2 or a.std() <= TINY or b.std() <= TINY:
            return None
        za, zb = (a - a.mean()) / a.std(), (b - b.mean()) / b.std()
        lags = np.arange(-max_lag, max_lag + 1)
        padded = np.concatenate([np.zeros(max_lag), za, np.zeros(max_lag)])
        shifted = np.lib.stride_tricks.sliding_window_view(padded, size)  # row k: z_x(i + lags[k])
        own = shifted @ zb / size
        high, low = np.zeros(len(lags), int), np.zeros(len(lags), int)
        step = max(1, 2_000_000 // size)
        for first in range(1, n + 1, step):
            rep = np.arange(first, min(n, first + step - 1) + 1)
            order = np.argsort(draws(i[None, :], rep[:, None], seed), axis=1, kind="stable")
            mixed = np.empty((len(rep), size))
            np.put_along_axis(mixed, order, np.broadcast_to(zb, (len(rep), size)), axis=1)
            r = mixed @ shifted.T / size
            high += (r >= own - TINY).sum(axis=0)
            low += (r <= own + TINY).sum(axis=0)
        pos, neg = high / n, low / n
        sig = np.minimum(pos, neg) < alpha / 2
        return {"lag": lags, "r": own, "n_rep": np.full(len(lags), n), "p_pos": pos, "p_neg": neg, "p": np.where(~(pos < alpha / 2) & (neg < alpha / 2), neg, pos), "significant": sig}

    return per_series(gather(known, by, index, [x, y]), by, kernel, "lag int, r double, n_rep long, p_pos double, p_neg double, p double, significant boolean")


def label_permutations(df: DataFrame, by: list[str], value: str, label: str, salt: str, n: int = 1000, alpha: float = 0.05, seed: int = 1) -> DataFrame:
    """by..., observed, n_rep, p, significant, direction: selectivity (2 AUC - 1) of ``value`` between the labels 1 and 0 against
    ``n`` permutations of the labels within ``by``; p is the part at least as far from 0.

    ``salt`` is one of ``by``, a whole number that makes the draws of units differ. A ``by`` with one label only gives no row.
    """
    first = F.array_sort(F.collect_list(F.struct(F.col(label).cast("int").alias("l"), F.col(value).cast("double").alias("v"))))
    s = df.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*by).agg(first.alias("_s"))
    s = s.select(*by, F.transform("_s", lambda x: x["v"]).alias("_v"), F.aggregate("_s", F.lit(0), lambda a, x: a + x["l"]).alias("_n1"))

    def kernel(row: dict) -> dict | None:
        v, n1 = np.asarray(row["_v"], float), int(row["_n1"])
        size = len(v)
        if n1 == 0 or n1 == size:
            return None
        rank = midranks(v)
        auc = lambda total: 2 * (total - n1 * (n1 + 1) / 2) / (n1 * (size - n1)) - 1
        own = auc(rank[size - n1 :].sum())  # sorted by label: the ones are last
        far, i, step = 0, np.arange(1, size + 1), max(1, 2_000_000 // size)
        for a in range(1, n + 1, step):
            rep = np.arange(a, min(n, a + step - 1) + 1) + int(row[salt])
            key = draws(i[None, :], rep[:, None], seed) * (size + 1) + i
            chosen = np.argpartition(key, n1 - 1, axis=1)[:, :n1]
            far += int((np.abs(auc(rank[chosen].sum(axis=1))) >= abs(own) - 1e-12).sum())
        p = far / n
        return {"observed": [own], "n_rep": [n], "p": [p], "significant": [p < alpha], "direction": [("positive" if own > 0 else "negative") if p < alpha else None]}

    return per_series(s, by, kernel, "observed double, n_rep long, p double, significant boolean, direction string")


def focality_bootstrap(cells: DataFrame, group: str, entity: str | None, n: int = 10_000, seed: int = 1) -> DataFrame:
    """group, focality, low, high, n_rep: percentile interval of the focality (sum of squared area shares over their squared
    sum) over resampled neurons.

    ``cells``: group, [entity,] area, k (significant), n (all neurons). Neurons of one area and outcome are alike, so drawing
    neurons with replacement is a multinomial draw over areas and outcomes: the work does not grow with the neurons. With
    ``entity`` (mouse), entities are drawn with replacement first, and as many neurons as each has for every time it is drawn.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["_g"].iloc[0]
        pdf = pdf.sort_values(["_e", "_a"])
        who, areas = pd.factorize(pdf["_e"])[0], pd.factorize(pdf["_a"], sort=True)[0]
        rng = np.random.default_rng([seed, *str(name).encode()])
        m, w = who.max() + 1, areas.max() + 1
        hit, all_ = np.zeros((m, w)), np.zeros((m, w))
        np.add.at(hit, (who, areas), pdf["_k"].to_numpy(float))
        np.add.at(all_, (who, areas), pdf["_n"].to_numpy(float))

        def focal(k: np.ndarray, total: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total > 0, k / total, 0.0)
                return (p * p).sum(axis=-1) / p.sum(axis=-1) ** 2

        out = np.empty(n)
        for a in range(0, n, 500):
            reps = min(500, n - a)
            times = np.ones((reps, m), int) if entity is None else rng.multinomial(m, np.full(m, 1 / m), size=reps)
            k, total = np.zeros((reps, w)), np.zeros((reps, w))
            for e in range(m):
                size = all_[e].sum()
                if size:
                    part = np.concatenate([hit[e], all_[e] - hit[e]]) / size
                    got = rng.multinomial((times[:, e] * size).astype(int), part)
                    k += got[:, :w]
                    total += got[:, :w] + got[:, w:]
            out[a : a + reps] = focal(k, total)
        own = focal(hit.sum(axis=0), all_.sum(axis=0))
        good = out[np.isfinite(out)]
        low, high = np.quantile(good, [0.025, 0.975]) if len(good) else (np.nan, np.nan)
        return pd.DataFrame({"_g": [name], "focality": [own], "low": [low], "high": [high], "n_rep": [len(good)]})

    e = F.col(entity).cast("string") if entity else F.lit("")
    g = cells.groupBy(F.col(group).alias("_g"), e.alias("_e"), F.col("area").alias("_a")).agg(F.sum("k").alias("_k"), F.sum("n").alias("_n"))
    kind = g.schema["_g"].dataType.simpleString()
    out = g.groupBy("_g").applyInPandas(kernel, f"_g {kind}, focality double, low double, high double, n_rep long")
    return out.withColumnRenamed("_g", group)
