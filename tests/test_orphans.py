import random
from datetime import datetime, timedelta

from axonlake.operators import orphans

T0 = datetime(2024, 1, 1)


def run(spark, refs, parents, **kw):
    r = spark.createDataFrame(refs, "result_id long, s string, n long, at timestamp_ntz, _scope string, _num int")
    p = spark.createDataFrame(parents, "session_id string, k long, registered_at timestamp_ntz, deleted_at timestamp_ntz, _from int")
    o = orphans.orphan_references([orphans.Reference("r", r, "result_id", "s", "n", "at", "session_id", "k")], p, **kw)
    return o


def test_against_brute_force(spark):
    g = random.Random(3)
    day = lambda: T0 + timedelta(days=g.uniform(0, 300))
    parents = []
    for _ in range(150):
        a = day()
        parents.append((g.choice("abc"), g.choice([-5, *range(130)]), a, g.choice([None, a + timedelta(days=g.uniform(0, 90))]), 1))
    parents += [(None, 1, T0, None, 1), ("a", None, T0, None, 1), ("a", 3, None, None, 1)]
    refs = [(i, g.choice("abcd"), g.choice([-5, *range(140)]), day(), "x", 1) for i in range(600)]
    refs += [(1000, "a", None, day(), "x", 1), (1001, None, 3, day(), "x", 1), (1002, "a", 3, None, "x", 1), refs[0], refs[5]]
    want = set()
    for i, s, n, at, *_ in refs:
        if n is not None and not any(ps == s and pn == n and s is not None and f and at and f <= at and (e is None or e > at) for ps, pn, f, e, _ in parents):
            want.add(i)
    got = [r.result_id for r in run(spark, refs, parents).collect()]
    assert sorted(got) == sorted(want)


def test_edges_of_validity_and_states(spark):
    p = [("a", 1, T0, T0 + timedelta(days=60), 1), ("a", 2, T0 + timedelta(days=60), None, 1)]
    refs = [(1, "a", 1, T0, "", 1), (2, "a", 1, T0 + timedelta(days=60), "", 1), (3, "a", 2, T0 + timedelta(days=60), "", 1), (4, "a", 2, T0, "", 1), (5, "a", 9, T0, "", 1)]
    assert {(r.result_id, r.state) for r in run(spark, refs, p).collect()} == {(2, "deleted"), (4, "early"), (5, "unknown")}


def test_empty_sides_and_hot_key(spark):
    assert run(spark, [], [("a", 1, T0, None, 1)]).count() == 0
    refs = [(i, "a", 7, T0 + timedelta(days=i % 50), "", 1) for i in range(500)]
    assert run(spark, refs, []).count() == 500
    assert run(spark, refs, [("a", 7, T0, None, 1)]).count() == 0
    c = orphans.orphan_counts(run(spark, refs, [])).toPandas()
    assert c.n_refs.sum() == 500 and set(c.n_keys) == {1}


def test_bitmap_round_trip(spark):
    ids = [0, 1, 63, 64, 127, 1_000_000, -1, -64]
    b = orphans.bitmap(spark.createDataFrame([(i,) for i in ids * 3], "n long"), [], "n")
    assert sorted(r[0] for r in orphans.decode(b).select("_num").collect()) == sorted(ids)


def test_plans_agree_and_far_dates_cost_nothing(spark):
    """The salted merge joins give what the broadcasts give; one reference in the year 9999 adds one period, not a hundred thousand."""
    g = random.Random(5)
    day = lambda: T0 + timedelta(days=g.uniform(0, 300))
    parents = []
    for _ in range(200):
        a = day()
        parents.append((g.choice("abc"), g.choice(range(90)), a, g.choice([None, a + timedelta(days=g.uniform(0, 90))]), 1))
    refs = [(i, g.choice("abcd"), g.choice(range(100)), day(), "x", 1) for i in range(500)] + [(900, "a", 5, datetime(9999, 1, 2), "x", 1), (901, "a", 95, datetime(9999, 1, 2), "x", 1)]
    one, two = (sorted((r.result_id, r.state) for r in run(spark, refs, parents, broadcast_rows=n).collect()) for n in (50_000, 0))
    assert one == two and (901, "unknown") in one
