import math
import random

from axonlake.operators.regular import event_rates, gaps, regular_grid

SCHEMA = "k string, id long, t double, value double, cell string, _t string, n string"


def grid(spark, rows, **kw):
    return {(r.k, r.cell): r for r in regular_grid(spark.createDataFrame([(*x, "x", "x", "x") for x in rows], SCHEMA), ["k"], **kw).collect()}


def test_cells_against_brute_force(spark):
    g = random.Random(1)
    rows = []
    for k in ("a", "b", None):
        t = -3.0
        for i in range(200):
            t += g.choice([0.05, 0.1, 0.3, 2.0])
            rows.append((k, len(rows), t, g.choice([1.0, 2.0, None, float("nan")])))
    rows.append(rows[0])
    got = grid(spark, rows, reading_id="id")
    for k in ("a", "b", None):
        own = {math.floor(t / 0.25) for kk, _, t, v in rows if kk == k and v is not None and v == v}
        every = set(range(min(own), max(own) + 1))
        assert {c for kk, c in got if kk == k} == every
        assert {c for (kk, c), r in got.items() if kk == k and r.status == "observed"} == own
        assert all((r.value is None) == (r.status == "missing") for (kk, _), r in got.items() if kk == k)


def test_a_line_comes_back_and_repeats_count_once(spark):
    rows = [("a", i, i * 0.05, 3 + 2 * i * 0.05) for i in range(200) if not 100 <= i < 104]
    got = grid(spark, rows + rows[:50], reading_id="id")
    inner = [r for (_, c), r in got.items() if 1 <= c < 38]
    assert all(abs(r.value - (3 + 2 * r.t_center)) < 1e-6 for r in inner)
    assert sum(r.n for r in got.values()) == len(rows)


def test_long_gaps_are_marked(spark):
    got = grid(spark, [("a", 1, 0.1, 5.0), ("a", 2, 2500.1, 6.0)])
    assert len(got) == 10001 and sum(r.status == "missing" for r in got.values()) >= 9995


def test_empty_and_single(spark):
    assert grid(spark, []) == {}
    one = grid(spark, [("a", 1, 7.0, 5.0)])
    assert [(r.status, r.value) for r in one.values()] == [("observed", 5.0)]


def test_gaps_do_not_depend_on_chunks(spark):
    g = random.Random(2)
    cells = sorted({g.randrange(-500, 3000) for _ in range(200)})
    df = spark.createDataFrame([("a", c) for c in cells], "k string, cell long")
    want = sorted(set(range(cells[0], cells[-1])) - set(cells))
    for chunk in (16, 100, 4096):
        assert sorted(r.cell for r in gaps(df, ["k"], chunk=chunk).collect()) == want


def test_events(spark):
    df = spark.createDataFrame([("a", t) for t in (0.5, 0.6, 1.5, 4.2, None, float("nan"))], "k string, t double")
    got = {r.cell: (r.n, r.status) for r in event_rates(df, ["k"]).collect()}
    assert [c for c, x in got.items() if x[1] == "observed"] and set(got) == {0, 1, 2, 3, 4}
    assert {c for c, x in got.items() if x[1] != "observed"} == {2, 3}


def test_values_against_plain_fits(spark):
    """Every cell's value and support against a fit over all readings of its stream, whatever the chunks."""
    g = random.Random(4)
    rows = [(k, 1000 * j + i, g.uniform(0, 60) + 200 * (i > 80), g.gauss(5, 2)) for j, k in enumerate(("a", None)) for i in range(160)]
    for chunk in (4, 1024):
        got = grid(spark, rows + rows[:9], reading_id="id", chunk=chunk)
        for k in ("a", None):
            own = [(t, v) for kk, _, t, v in rows if kk == k]
            cells = [math.floor(t / 0.25) for t, _ in own]
            assert {c for kk, c in got if kk == k} == set(range(min(cells), max(cells) + 1))
            for c in range(min(cells), max(cells) + 1):
                near = [(t / 0.25 - c - 0.5, v) for t, v in own if abs(t / 0.25 - c - 0.5) < 1.5]
                w = [(1 - (abs(u) / 1.5) ** 3) ** 3 + 1e-6 for u, _ in near]
                s = [sum(x * u**e for x, (u, _) in zip(w, near)) for e in (0, 1, 2)]
                r = [sum(x * v * u**e for x, (u, v) in zip(w, near)) for e in (0, 1)]
                support = s[0] ** 2 / sum(x * x for x in w) if w else 0.0
                det = s[0] * s[2] - s[1] ** 2
                row = got[k, c]
                assert row.n == cells.count(c) and abs(row.support - support) < 1e-9
                assert row.status == ("observed" if row.n else "filled" if support >= 1.5 else "missing")
                if row.status != "missing":
                    assert abs(row.value - ((s[2] * r[0] - s[1] * r[1]) / det if det > 1e-3 * s[0] ** 2 else r[0] / s[0])) < 1e-6
                else:
                    assert row.value is None
