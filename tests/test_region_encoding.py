"""res_region_all: every analysis, group and area, against plain loops over mice."""

import random
from collections import defaultdict
from datetime import datetime

import numpy as np
import pytest

import __spark_entry__
from axonlake.operators import series

ANALYSES = ["whisker_passive_pre", "whisker_passive_post", "auditory_active", "choice"]
ROC = "result_id long, mouse_id string, session_id string, neuron_id long, cluster_id long, area_acronym_custom string, analysis_type string, auc double, selectivity double, fpr array<double>, tpr array<double>, thresholds array<double>, significant boolean, direction string, p_value double, computed_at timestamp"


def result(i, mouse, area, analysis, significant):
    return (i, mouse, f"{mouse}_s", i % 17, i, area, analysis, 0.5, 0.1, [0.0], [1.0], [0.5], significant, None, 0.2, datetime(2024, 1, 1))


def adjusted(p):
    q, out = 1.0, {}
    for rank, key in sorted(enumerate(sorted(p, key=p.get), 1), reverse=True):
        q = min(q, p[key] * len(p) / rank)
        out[key] = q
    return out


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """The rows counted, and the query's result on them."""
    path, g = tmp_path_factory.mktemp("regions"), random.Random(3)
    rows = []
    for m in range(9):
        for area in ["A", "B", "C", "D"][: 2 + m % 3] + [None] * (m == 8) + ["single"] * (m == 4):
            for a in ANALYSES[: 3 if m == 7 else 4]:
                rate = 0.9 if area == "B" and a == "choice" else 0.3
                rows += [(f"m{m}", area, a, None if g.random() < 0.05 else g.random() < rate) for _ in range(g.randrange(1, 9))]
    rows += [(f"m{m}", "unknown", "choice", None) for m in (0, 2)]  # an area without any outcome
    own = list(rows)
    rows += [(None, "A", "choice", True), ("without units", "A", "choice", True), ("no group", "A", "choice", True), ("m0", "A", None, True)]
    data = [result(i, *r) for i, r in enumerate(rows)]
    spark.createDataFrame(data + data[:40], ROC).write.parquet(f"{path}/roc_results.parquet")  # rows delivered twice
    spark.createDataFrame([(f"m{m}", m % 2) for m in range(9)] + [("no group", None)], "mouse_id string, reward_group int").write.parquet(f"{path}/units.parquet")
    got = __spark_entry__.queries()["res_region_all"](spark, str(path)).collect()
    return own, got


def test_every_analysis_group_and_area_is_tested(found):
    own, got = found
    seen = defaultdict(set)
    for mouse, area, analysis, _ in own:
        if area:
            seen[analysis, int(mouse[1]) % 2, area].add(mouse)
    want = {k for k, m in seen.items() if len(m) > 1}
    assert {k[0] for k in want} == set(ANALYSES)
    assert sorted((x.analysis_type, x.reward_group, x.area) for x in got) == sorted(want)
    for x in got:
        here = [r for r in own if (r[2], int(r[0][1]) % 2, r[1]) == (x.analysis_type, x.reward_group, x.area)]
        assert (x.n_mice, x.n_neurons, x.n_significant) == (len({r[0] for r in here}), len(here), sum(r[3] is True for r in here))
        assert (x.n_boot, x.n_perm) == ((0, 0) if x.area == "unknown" else (5000, 10_000))


def test_against_plain_loops(found):
    own, got = found
    number = {m: i for i, m in enumerate(sorted({r[0] for r in own} | {"no group"}), 1)}

    def share(mice, pool):
        known = [r[3] for r in pool if r[0] in mice and r[3] is not None]
        return sum(known) / len(known) if known else None

    p = defaultdict(dict)
    for x in got:
        p[x.analysis_type, x.reward_group][x.area] = x.p
    checked = 0
    for x in got:
        if x.area == "unknown":
            assert (x.observed_proportion, x.bootstrap_mean, x.z, x.p, x.p_adj, x.encodes, x.exceeds_baseline, x.ci_excludes_baseline) == (None, None, None, None, None, False, False, False)
            continue
        q = adjusted({k: v for k, v in p[x.analysis_type, x.reward_group].items() if v is not None})[x.area]
        assert abs(x.p_adj - q) < 1e-9 and x.encodes == (q < 0.05)
        if x.analysis_type not in ("choice", "auditory_active"):
            continue
        checked += 1
        pool = [r for r in own if r[2] == x.analysis_type and int(r[0][1]) % 2 == x.reward_group]
        here = [r for r in pool if r[1] == x.area]
        mice, all_mice = sorted({r[0] for r in here}), sorted({r[0] for r in pool})
        observed = share(mice, here)
        memo_b, memo_p, boot, null = {}, {}, [], []
        for y in series.mixed(np.arange(len(mice))[None, :] + 1, np.arange(1, 5001)[:, None]):
            s = frozenset(mice[int((int(v) >> 11) / 2**53 * len(mice))] for v in y)
            boot.append(memo_b[s] if s in memo_b else memo_b.setdefault(s, share(s, here)))
        for y in series.mixed(np.array([number[m] for m in all_mice])[None, :], np.arange(1, 10_001)[:, None], 2):
            s = frozenset(m for _, m in sorted(zip(y, all_mice))[: len(mice)])
            null.append(memo_p[s] if s in memo_p else memo_p.setdefault(s, share(s, pool)))
        boot, null = np.array([b for b in boot if b is not None]), np.array(null)
        want = [observed, boot.mean(), boot.std(), boot.mean() - 1.96 * boot.std(), boot.mean() + 1.96 * boot.std(), null.mean(), null.std(), (null >= observed).mean()]
        have = [x.observed_proportion, x.bootstrap_mean, x.bootstrap_se, x.ci_lower, x.ci_upper, x.perm_null_mean, x.perm_null_std, x.p]
        assert np.allclose(have, want, rtol=0, atol=1e-7), (x, want)
        assert x.exceeds_baseline == (observed > 0.05) and x.ci_excludes_baseline == (x.ci_lower > 0.05)
        assert x.z is None if null.std() < 1e-9 else abs(x.z - (observed - null.mean()) / null.std()) < 1e-6
    assert checked >= 10


def test_pairs_are_drawn_evenly():
    """Every pair of 8 is among 3 drawn in 3 of 28 repetitions, up to five deviations."""
    y = series.mixed(np.arange(1, 9)[None, :], np.arange(1, 10_001)[:, None], 2)
    inside = np.zeros(y.shape)
    np.put_along_axis(inside, np.argsort(y, axis=1)[:, :3], 1.0, axis=1)
    pairs = (inside.T @ inside / 10_000)[~np.eye(8, dtype=bool)]
    assert np.abs(pairs - 3 / 28).max() < 5 * (3 / 28 * 25 / 28 / 10_000) ** 0.5


def test_draws_do_not_depend_on_blocks(spark):
    r = np.random.default_rng(8)
    cells = [("g", a, m, int(r.integers(0, 6)), 6, 6) for m in range(40) for a in "ab"[: 1 + m % 2]]
    df = spark.createDataFrame(cells, "g string, area string, mouse long, k long, known long, n long")
    one, other = (sorted(tuple(x) for x in series.region_encoding(df, ["g"], "area", "mouse", n_boot=300, n_perm=700, block=b, size=s).collect()) for b, s in ((1000, 2_000_000), (90, 200)))
    assert len(one) == 2
    for x, y in zip(one, other):
        assert all(u == v or abs(u - v) < 1e-9 for u, v in zip(x, y))
