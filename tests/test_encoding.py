import numpy as np
from pyspark.sql import functions as F

from axonlake.operators import encoding as enc

BINS = enc.Bins(-200_000, 100_000, 8)
KERNELS = {"stim": (1, 2), "late": (0, 2)}


def trials(spark, n=40):
    r = np.random.default_rng(1)
    rows = [("s", i, i * 2_000_000, i * 2_000_000 if i % 3 else None, i * 2_000_000 + int(r.integers(-400_000, 900_000)), float(i) if i else None, i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "session_id string, event_id long, at_us long, t_stim long, t_late long, index double, fold long")


def test_design_against_plain_loops(spark):
    t = trials(spark, 12)
    samples = spark.createDataFrame([("s", "jaw", i * 70_000, float(i % 7)) for i in range(400)], "session_id string, signal string, t_us long, value double")
    got = {(r.event_id, r.bin): r for r in enc.design_matrix(t, ["session_id"], "event_id", "at_us", {"stim": "t_stim", "late": "t_late"}, ["index"], KERNELS, BINS, samples, ["jaw"]).collect()}
    assert len(got) == 12 * 8
    for r in t.collect():
        for b in range(8):
            row = got[r.event_id, b]
            for name, at in (("stim", r.t_stim), ("late", r.t_late)):
                before, after = KERNELS[name]
                own = (at - r.at_us + 200_000) // 100_000 if at is not None else None
                for s, c in zip(range(-before, after), enc.kernel_columns({name: KERNELS[name]})):
                    assert row[c] == float(own is not None and 0 <= own < 8 and b == own + s)
            lo = r.at_us - 200_000 + b * 100_000
            v = [i % 7 for i in range(400) if lo <= i * 70_000 < lo + 100_000]
            assert row["index"] == (r["index"] or 0.0) and row.offset == 1.0 and abs(row.jaw - (np.mean(v) if v else 0.0)) < 1e-12


def test_fits_against_plain_ridge(spark):
    """Penalty, weights and scores of every unit, fold and model as by solving each alone; more units than a block."""
    t = trials(spark)
    d = enc.design_matrix(t, ["session_id"], "event_id", "at_us", {"stim": "t_stim", "late": "t_late"}, ["index"], KERNELS, BINS).join(t.select("event_id", "fold"), "event_id")
    cols = ["offset", "index", *enc.kernel_columns(KERNELS)]
    x = d.orderBy("event_id", "bin").toPandas()
    r = np.random.default_rng(2)
    big = x[cols].to_numpy(float)
    y = {u: r.poisson(np.maximum(0.2, 1 + big[:, 2:] @ r.normal(0, 2, big.shape[1] - 2))) for u in range(5)}
    y[5] = np.zeros(len(x), int)  # a unit without spikes
    rows = [("s", u, int(e), int(b), int(n)) for u, v in y.items() for e, b, n in zip(x.event_id, x.bin, v) if n]
    counts = spark.createDataFrame(rows, "session_id string, unit_id long, event_id long, bin int, n long")
    units = spark.createDataFrame([("s", u) for u in y] + [("empty", 9)], "session_id string, unit_id long")
    models = {"full": cols, **enc.groups_of(cols, ("stim",)), "masked": cols}
    masks = {"masked": {"stim_p0": (2,)}}
    got = enc.fit_binned(d, counts, units, "session_id", "unit_id", "event_id", "fold", models, ("index",), masks, block=4).collect()
    assert len(got) == 6 * 4 * 3
    trial, fold, bin_ = x.event_id.to_numpy(), x.fold.to_numpy(), x.bin.to_numpy()
    order = {e: i for i, e in enumerate(dict.fromkeys(trial))}
    part = np.array([order[e] for e in trial]) % 5
    for g in got:
        tr, te, v = fold != g.fold, fold == g.fold, y[g.unit_id].astype(float)
        z = big.copy()
        z[:, 1] = (z[:, 1] - z[tr, 1].mean()) / z[tr, 1].std()
        score = lambda a, b: 1 - ((a - b) ** 2).sum() / ((a - a.mean()) ** 2).sum() if a.std() > 0 else 0.0
        solve = lambda m, at, lam: np.linalg.solve(m[at].T @ m[at] + lam * np.eye(m.shape[1]), m[at].T @ v[at])  # noqa: E731, B023
        best = max(enc.LAMBDAS, key=lambda lam: (sum(score(v[tr & (part == p)], z[tr & (part == p)] @ solve(z, tr & (part != p), lam)) for p in range(5)), -enc.LAMBDAS.index(lam)))  # noqa: B023
        use = z[:, [cols.index(c) for c in g.predictors]].copy()
        if g.model_name == "masked":
            use[bin_ != 2, cols.index("stim_p0")] = 0
        w = solve(use, tr, g.lambda_opt)
        assert abs(best - g.lambda_opt) < 1e-12 and np.abs(np.array(g.coef) - w).max() < 1e-6
        if g.unit_id == 5:
            assert g.test_score is None and g.test_mi is None
        else:
            assert abs(g.test_score - score(v[te], use[te] @ w)) < 1e-6 and abs(g.train_corr - np.corrcoef(v[tr], use[tr] @ w)[0, 1]) < 1e-6
    better = {(g.unit_id, g.fold): g.train_score for g in got if g.model_name == "full"}
    assert all(g.train_score <= better[g.unit_id, g.fold] + 1e-3 for g in got if g.model_name == "no_stim" and g.unit_id != 5)


def test_counts_per_bin(spark):
    t = trials(spark, 3)
    s = spark.createDataFrame([("s", 1, 2_000_000 + x) for x in (-200_001, -200_000, -1, 0, 599_999, 600_000)], "session_id string, unit_id long, t_us long")
    got = sorted((r.event_id, r.bin, r.n) for r in enc.binned_counts(s, t, ["session_id"], "unit_id", "event_id", BINS).where(F.col("event_id") == 1).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (1, 7, 1)]
