"""Model fits: regressions by summed normal equations, mixtures, densities, clusters, trees.

Fits of one model per unit run as grouped kernels; fits over all rows use Spark ML, whose passes are distributed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def aic(rss: float, n: int, k: int) -> float:
    return n * float(np.log(max(rss, 1e-12) / n)) + 2 * k


def sigmoid(t: np.ndarray, a: float, b: float, t0: float, k: float) -> np.ndarray:
    return a + b / (1 + np.exp(-np.clip(k * (t - t0), -60, 60)))


def fit_sigmoid(t: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Bounded Levenberg-Marquardt for a four-parameter sigmoid: (parameters, residual sum of squares). t0 stays inside the data."""
    span = max(float(t[-1] - t[0]), 1.0)
    best, best_rss = None, np.inf
    for frac in (0.25, 0.5, 0.75):
        p = np.array([y.min(), y.max() - y.min() or 1e-3, t[0] + frac * span, 8 / span])
        lam, rss = 1e-2, float(((y - sigmoid(t, *p)) ** 2).sum())
        for _ in range(steps):
            s = 1 / (1 + np.exp(-np.clip(p[3] * (t - p[2]), -60, 60)))
            g = s * (1 - s)
            jac = np.stack([np.ones_like(t), s, -p[1] * p[3] * g, p[1] * g * (t - p[2])], axis=1)
            r = y - (p[0] + p[1] * s)
            h = jac.T @ jac
            try:
                d = np.linalg.solve(h + lam * (np.diag(np.diag(h)) + 1e-9 * np.eye(4)), jac.T @ r)
            except np.linalg.LinAlgError:
                break
            q = p + d
            q[2], q[3] = np.clip(q[2], t[0], t[-1]), np.clip(q[3], 0.05 / span, 200 / span)
            new = float(((y - sigmoid(t, *q)) ** 2).sum())
            if new < rss:
                done = rss - new < 1e-10 * rss
                p, rss, lam = q, new, lam / 3
                if done:
                    break
            else:
                lam *= 4
                if lam > 1e8:
                    break
        if rss < best_rss:
            best, best_rss = p, rss
    return best, best_rss


def compare_models(df: DataFrame, by: list[str], index: str, value: str, least: int = 10) -> DataFrame:
    """Per ``by``: AIC of constant, linear and sigmoid, the best (sigmoid or linear only if better by more than 2), and the
    sigmoid's midpoint, slope and size. Groups of fewer than ``least`` rows give no row; null values are left out."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", n long, aic_constant double, aic_linear double, aic_sigmoid double, best string, midpoint double, slope double, size double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["_y"].notna()].sort_values("_t", kind="stable")
        n = len(pdf)
        if n < least:
            return pd.DataFrame(columns=[*by, "n", "aic_constant", "aic_linear", "aic_sigmoid", "best", "midpoint", "slope", "size"])
        t, y = np.arange(n, dtype=float), pdf["_y"].to_numpy(float)
        c = aic(float(((y - y.mean()) ** 2).sum()), n, 2)
        x = np.stack([np.ones(n), t], axis=1)
        line = aic(float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()), n, 3)
        p, rss = fit_sigmoid(t, y)
        s = aic(rss, n, 5)
        best = "sigmoid" if s < min(c, line) - 2 else "linear" if line < c - 2 else "constant"
        return pd.DataFrame([[*pdf[by].iloc[0], n, c, line, s, best, p[2], p[3], p[1]]], columns=[*by, "n", "aic_constant", "aic_linear", "aic_sigmoid", "best", "midpoint", "slope", "size"])

    given = df.select(*by, F.col(index).alias("_t"), F.col(value).cast("double").alias("_y"))
    return given.groupBy(*by).applyInPandas(one, schema)


def ridge_path(x: np.ndarray, y: np.ndarray, fold: np.ndarray, lambdas: list[float]) -> tuple[float, np.ndarray]:
    """The ridge penalty with the least cross-validated error, and the coefficients on all rows (no intercept)."""
    k = x.shape[1]
    folds = np.unique(fold)
    err = np.zeros(len(lambdas))
    for f in folds:
        tr = fold != f
        xx, xy = x[tr].T @ x[tr], x[tr].T @ y[tr]
        for i, lam in enumerate(lambdas):
            w = np.linalg.solve(xx + lam * np.eye(k), xy)
            err[i] += float(((y[~tr] - x[~tr] @ w) ** 2).sum())
    lam = lambdas[int(err.argmin())]
    return lam, np.linalg.solve(x.T @ x + lam * np.eye(k), x.T @ y)


def poisson_fit(x: np.ndarray, y: np.ndarray, lam: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Ridge-penalised Poisson regression with log link and intercept (first column of ones expected), by Newton steps."""
    w = np.zeros(x.shape[1])
    w[0] = np.log(max(y.mean(), 1e-6))
    pen = lam * np.eye(x.shape[1])
    pen[0, 0] = 0
    for _ in range(steps):
        mu = np.exp(np.clip(x @ w, -30, 30))
        g = x.T @ (y - mu) - pen @ w
        h = (x * mu[:, None]).T @ x + pen + 1e-9 * np.eye(x.shape[1])
        d = np.linalg.solve(h, g)
        w = w + np.clip(d, -5, 5)
        if np.abs(d).max() < 1e-8:
            break
    return w


def bits_per_event(y: np.ndarray, mu: np.ndarray) -> float:
    """Mutual information against a homogeneous Poisson rate, in bits per event; 0 without events."""
    n = y.sum()
    if n <= 0:
        return 0.0
    mu = np.maximum(mu, 1e-12)
    flat = np.full(len(y), max(y.mean(), 1e-12))
    return float(((y * np.log(mu) - mu).sum() - (y * np.log(flat) - flat).sum()) / n / np.log(2))


def fit_units(df: DataFrame, by: list[str], target: str, features: list[str], fold: str, family: str = "gaussian", models: dict[str, list[str]] | None = None, lambdas: tuple[float, ...] = (1e-3, 1e-2, 1e-1, 1.0, 10.0, 100.0)) -> DataFrame:
    """One fit per ``by``, model and held-out fold: train and test R squared (gaussian) or bits per event (poisson), correlation and coefficients.

    ``models`` maps a name to its features; default: full and one reduced model per left-out feature (with the full model's
    penalty). Features are standardised on the training rows. The rows of one unit form one kernel call.
    """
    models = models or {"full": features, **{f"no_{f}": [g for g in features if g != f] for f in features}}
    types = dict(df.dtypes)
    cols = [*by, "fold", "model_name", "predictors", "lambda_opt", "train_score", "test_score", "test_corr", "coef"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", fold long, model_name string, predictors array<string>, lambda_opt double, train_score double, test_score double, test_corr double, coef array<double>"

    def score(y: np.ndarray, mu: np.ndarray) -> float:
        if family == "poisson":
            return bits_per_event(y, mu)
        s = float(((y - y.mean()) ** 2).sum())
        return 1 - float(((y - mu) ** 2).sum()) / s if s > 0 else np.nan

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        y, fo = pdf[target].to_numpy(float), pdf[fold].to_numpy()
        for f in np.unique(fo):
            tr, te = fo != f, fo == f
            if tr.sum() < len(features) + 2:
                continue
            lam = None
            for name, cols_ in models.items():
                x = pdf[cols_].to_numpy(float)
                m, s = x[tr].mean(axis=0), x[tr].std(axis=0)
                x = (x - m) / np.where(s > 0, s, 1)
                if family == "poisson":
                    one_ = np.hstack([np.ones((len(x), 1)), x])
                    w = poisson_fit(one_[tr], y[tr])
                    mu, used = np.exp(np.clip(one_ @ w, -30, 30)), 1e-2
                else:
                    base = y[tr].mean()
                    if lam is None:
                        lam, w = ridge_path(x[tr], y[tr] - base, fo[tr], list(lambdas))
                    else:
                        w = np.linalg.solve(x[tr].T @ x[tr] + lam * np.eye(x.shape[1]), x[tr].T @ (y[tr] - base))
                    mu, used = base + x @ w, lam
                r = float(np.corrcoef(y[te], mu[te])[0, 1]) if te.sum() > 1 and y[te].std() > 0 and mu[te].std() > 1e-12 else np.nan
                out.append([*pdf[by].iloc[0], int(f), name, list(cols_), float(used), score(y[tr], mu[tr]), score(y[te], mu[te]), r, [float(v) for v in w]])
        return pd.DataFrame(out, columns=cols)

    need = df.select(*dict.fromkeys([*by, target, *features, fold])).dropna()
    return need.groupBy(*by).applyInPandas(one, schema)


def two_gaussians(x: np.ndarray, times: np.ndarray | None = None, steps: int = 200) -> dict:
    """EM for two 1-D Gaussians: weights, means, deviations (ordered by mean), where the densities cross, Ashman's D, valid.

    ``times``: how often each value occurs.
    """
    o = np.argsort(x, kind="stable")
    x = x[o]
    c = np.ones(len(x)) if times is None else np.asarray(times, float)[o]
    n_all = c.sum()
    at = np.cumsum(c) / n_all
    m = x[np.searchsorted(at, [0.25, 0.75])]
    mean = (c * x).sum() / n_all
    sd = np.sqrt((c * (x - mean) ** 2).sum() / n_all)
    s = np.full(2, sd or 1.0) / 2 + 1e-9
    w = np.full(2, 0.5)
    for _ in range(steps):
        d = w * np.exp(-0.5 * ((x[:, None] - m) / s) ** 2) / s
        r = d / np.maximum(d.sum(axis=1, keepdims=True), 1e-300) * c[:, None]
        n = r.sum(axis=0) + 1e-9
        new = (r * x[:, None]).sum(axis=0) / n
        s = np.sqrt((r * (x[:, None] - new) ** 2).sum(axis=0) / n) + 1e-6 * (x[-1] - x[0] or 1)
        w = n / n_all
        if np.abs(new - m).max() < 1e-9 * (abs(m).max() + 1):
            m = new
            break
        m = new
    o = np.argsort(m)
    m, s, w = m[o], s[o], w[o]
    a = 1 / s[1] ** 2 - 1 / s[0] ** 2
    b = 2 * (m[0] / s[0] ** 2 - m[1] / s[1] ** 2)
    c = m[1] ** 2 / s[1] ** 2 - m[0] ** 2 / s[0] ** 2 + 2 * np.log(w[0] * s[1] / (w[1] * s[0]))
    roots = np.roots([a, b, c]) if abs(a) > 1e-15 else np.array([-c / b]) if b else np.array([])
    between = [float(z.real) for z in roots if abs(z.imag) < 1e-9 and m[0] < z.real < m[1]]
    dist = float(np.sqrt(2) * abs(m[1] - m[0]) / np.sqrt((s**2).sum()))
    return {"w0": float(w[0]), "m0": float(m[0]), "s0": float(s[0]), "m1": float(m[1]), "s1": float(s[1]), "threshold": between[0] if between else None, "ashman_d": dist, "valid": bool(dist > 2 and between and w.min() > 0.05)}


def mixture_threshold(df: DataFrame, by: list[str], value: str, ranges: int = 64) -> DataFrame:
    """The two-Gaussian threshold per ``by`` from counts per range of values: a group of any size costs its occupied ranges.

    ``ranges`` per unit of asinh of the distance from the group's mean in its mean deviations: fine where the values are, coarse
    far out, so an extreme value squeezes nothing. A range stands for its rows with their mean value and their number. Groups of
    fewer than 10 values or 3 ranges give no row.
    """
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("_v"))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]
    mean = x.groupBy(*by).agg(F.avg("_v").alias("_m"))
    x = x.alias("x").join(mean.alias("m"), same("x", "m")).select("x.*", "m._m")
    scale = x.groupBy(*by).agg(F.avg(F.abs(F.col("_v") - F.col("_m"))).alias("_s"))
    x = x.alias("x").join(scale.alias("s"), same("x", "s")).select("x.*", "s._s")
    g = F.coalesce(F.floor(F.asinh(F.try_divide(F.col("_v") - F.col("_m"), F.col("_s"))) * ranges), F.lit(0))
    h = x.groupBy(*by, g.alias("_g")).agg(F.avg("_v").alias("_x"), F.count("*").alias("_n"))
    types = dict(df.dtypes)
    names = ["n", "w0", "m0", "s0", "m1", "s1", "threshold", "ashman_d", "valid"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in by) + ", n long, w0 double, m0 double, s0 double, m1 double, s1 double, threshold double, ashman_d double, valid boolean"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_n"].sum())
        if n < 10 or len(pdf) < 3:
            return pd.DataFrame(columns=[*by, *names])
        return pd.DataFrame([[*pdf[by].iloc[0], n, *two_gaussians(pdf["_x"].to_numpy(), pdf["_n"].to_numpy()).values()]], columns=[*by, *names])

    return h.groupBy(*by).applyInPandas(one, schema)


def kde(df: DataFrame, by: list[str], value: str, grid: list[float]) -> DataFrame:
    """Gaussian density on a grid with Scott's bandwidth, per ``by``: by, x, density (null for a constant or a single row)."""
    g = W.partitionBy(*by)
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).alias("_v"))
    x = x.withColumn("_n", F.count("*").over(g)).withColumn("_h", F.stddev_samp("_v").over(g) * F.pow(F.count("*").over(g), F.lit(-0.2)))
    x = x.where("_h > 0").withColumn("x", F.explode(F.array(*[F.lit(float(a)) for a in grid])))
    u = (F.col("x") - F.col("_v")) / F.col("_h")
    return x.groupBy(*by, "x").agg((F.sum(F.exp(-0.5 * u * u)) / F.max(F.col("_n") * F.col("_h") * 2.5066282746310002)).alias("density"))


def vectors(df: DataFrame, array: str, name: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(name, array_to_vector(F.col(array).cast("array<double>")))


def kmeans(df: DataFrame, k: int, seed: int = 42) -> tuple[DataFrame, float]:
    """Rows with ``cluster``, and the inertia."""
    from pyspark.ml.clustering import KMeans

    m = KMeans(k=k, seed=seed, maxIter=30, initSteps=5).fit(df)
    return m.transform(df).withColumnRenamed("prediction", "cluster"), m.summary.trainingCost


def pca_variance(df: DataFrame, k: int) -> list[float]:
    from pyspark.ml.feature import PCA

    return [float(v) for v in PCA(k=k, inputCol="features", outputCol="pcs").fit(df).explainedVariance]


def linkage_labels(points: np.ndarray, n_clusters: int) -> np.ndarray:
    """Average-linkage clusters on 1 - r of a few vectors (cluster means, not rows); r of a constant is 0."""
    s = points.std(axis=1)
    z = (points - points.mean(axis=1, keepdims=True)) / np.where(s > 0, s, 1)[:, None]
    dist = 1 - z @ z.T / points.shape[1]
    groups = [[i] for i in range(len(points))]
    while len(groups) > n_clusters:
        best = min(((float(dist[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    out = np.zeros(len(points), int)
    for k, g in enumerate(groups):
        out[g] = k
    return out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0)))


def lz76(bits: str) -> int:
    """Lempel-Ziv (1976) complexity: the number of phrases not seen before."""
    n, i, c = len(bits), 0, 0
    while i < n:
        k = 1
        while i + k <= n and bits[i : i + k] in bits[: i + k - 1]:
            k += 1
        c += 1
        i += k
    return c


def forest(train: DataFrame, features: list[str], label: str, weight: str | None = None, trees: int = 40, seed: int = 42):
    """Median imputation and a random forest; rows may be weighted to balance classes. A fitted pipeline whose ``probability`` holds the score."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import Imputer, VectorAssembler

    filled = [f"{f}_filled" for f in features]
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=6, seed=seed)
    if weight:
        rf = rf.setWeightCol(weight)
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="features"), rf]).fit(train)
