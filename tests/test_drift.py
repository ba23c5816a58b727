import json
from datetime import datetime, timedelta

import numpy as np

from axonlake.operators import drift

SCHEMA = "source_id string, file_id long, kind string, written_at timestamp_ntz, row_no int, payload string"


def exports(spark, files):
    out = []
    for i, (source, fid, records) in enumerate(files):
        at = datetime(2024, 1, 1) + timedelta(days=9 * i)
        out += [(source, fid, "unit_table", at, k, r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(records)]
    return spark.createDataFrame(out, SCHEMA)


def changes(spark, files):
    return sorted(tuple(r) for r in drift.schema_changes(exports(spark, files)).collect())


def records(n=12, **names):
    r = np.random.default_rng(len(names))
    kinds = {"rate": lambda: round(float(r.lognormal(1, 1)), 3), "label": lambda: str(r.choice(["good", "mua", "noise"])), "depth": lambda: round(float(r.uniform(0, 4000)), 1), "flag": lambda: int(r.integers(0, 2)), "text": lambda: str(r.uniform(0, 9))}
    return [{k: kinds[v]() for k, v in names.items()} for _ in range(n)]


def test_kinds_of_change(spark):
    a = records(rate="rate", bc="label", depth="depth")
    b = records(mean_hz="rate", bc="label", depth="depth", lick="flag")
    c = [{**x, "depth": str(x["depth"])} for x in b]
    d = [{k: v for k, v in x.items() if k != "lick"} for x in c]
    assert changes(spark, [("s", 9, a), ("s", 3, b), ("s", 7, c), ("s", 1, d)]) == [(1, "removed", "lick", ""), (3, "added", "", "lick"), (3, "renamed", "rate", "mean_hz"), (7, "retyped", "depth", "depth")]


def test_null_throughout_keeps_the_type_and_case_counts(spark):
    a = records(x="depth", Label="label")
    none = [{**r, "x": None} for r in a]
    text = [{**r, "x": "7"} for r in a]
    assert changes(spark, [("s", 1, a), ("s", 2, none), ("s", 3, a), ("s", 4, none), ("s", 5, text)]) == [(5, "retyped", "x", "x")]
    lower = [{"x": r["x"], "label": r["Label"]} for r in a]
    assert changes(spark, [("s", 1, a), ("s", 2, lower)]) == [(2, "renamed", "Label", "label")]


def test_different_values_are_no_rename(spark):
    assert changes(spark, [("s", 1, records(x="depth", y="flag")), ("s", 2, records(x="depth", z="label"))]) == [(2, "added", "", "z"), (2, "removed", "y", "")]


def test_sources_are_apart_and_odd_rows_do_no_harm(spark):
    a = records(x="depth")
    assert changes(spark, [("s", 1, a), ("t", 2, records(y="label"))]) == []
    assert changes(spark, [("s", 1, [*a, *a, None, "", "no json", "[1]"]), ("s", 2, a)]) == []
    assert changes(spark, []) == []
    assert changes(spark, [(None, 1, a), (None, 2, records(x="depth", y="flag"))]) == [(2, "added", "", "y")]


def test_assignment_is_the_best():
    r = np.random.default_rng(1)
    from itertools import permutations

    for n, m in [(3, 3), (2, 4), (4, 2), (1, 1)]:
        s = r.random((n, m))
        got = sum(s[i, j] for i, j in drift.assign(s))
        k = min(n, m)
        best = max(sum((s if n <= m else s.T)[i, p[i]] for i in range(k)) for p in permutations(range(max(n, m)), k))
        assert abs(got - best) < 1e-9


def test_unified_table(spark):
    a, b = records(rate="rate", bc="label"), records(mean_hz="rate", bc="label")
    u = drift.unify(exports(spark, [("s", 1, a), ("s", 2, b), ("s", 3, a)]))
    got = {(r.file_id, r.field) for r in u.select("file_id", "field").distinct().collect()}
    assert got == {(f, n) for f in (1, 2, 3) for n in ("rate", "bc")}


def test_large_unrelated_columns_are_no_rename(spark):
    """Sketches do not fill up: text columns of 100,000 values with nothing in common stay apart, a true rename is found."""
    n = 100_000
    at = datetime(2024, 1, 1)
    i = spark.range(n)
    one = i.selectExpr("'s' AS source_id", "1L AS file_id", "'k' AS kind", f"timestamp_ntz'{at}' AS written_at", "CAST(id AS INT) AS row_no", "to_json(struct(concat('AB', lpad(id, 6, '0')) AS code, concat(id % 977, '/', id) AS path)) AS payload")
    two = i.selectExpr("'s' AS source_id", "2L AS file_id", "'k' AS kind", f"timestamp_ntz'{at + timedelta(days=1)}' AS written_at", "CAST(id AS INT) AS row_no", "to_json(struct(concat('x', id, '-a') AS tag, concat(id % 977, '/', id + 20) AS place)) AS payload")
    got = sorted(tuple(r) for r in drift.schema_changes(one.unionByName(two)).collect())
    assert got == [(2, "added", "", "tag"), (2, "removed", "code", ""), (2, "renamed", "path", "place")]


def test_long_chains_of_renames_get_one_name(spark):
    names = [f"n{i:02d}" for i in range(30)]
    pairs = spark.createDataFrame([(i + 1, "renamed", a, b) for i, (a, b) in enumerate(zip(names, names[1:]))], "file_id long, change string, field_from string, field_to string")
    kinds = spark.createDataFrame([(i, "k") for i in range(31)], "file_id long, kind string")
    profiles = spark.createDataFrame([("k", n, i) for i, n in enumerate(names)] + [("k", names[-1], 99), ("k", "alone", 5)], "kind string, field string, file_id long")
    got = {r.field: r.canonical for r in drift.canonical_names(pairs, profiles, kinds).collect()}
    assert got == {**dict.fromkeys(names, names[-1]), "alone": "alone"}


def test_types_of_values(spark):
    rows = ['{"a": 1, "b": 1.0, "c": true, "d": [1, "x"], "e": {"k": 1}, "f": null, "g": "1", "h": 12345678901234567890}', '{"a": 2, "b": 2, "f": null}']
    p = {r.field: r for r in drift.profile_fields(exports(spark, [("s", 1, rows)])).collect()}
    assert {k: r.json_type for k, r in p.items()} == {"a": "integer", "b": "number", "c": "boolean", "d": "array", "e": "object", "f": None, "g": "string", "h": "integer"}
    assert p["f"].n_null == 2 and p["b"].n_integer == 1 and p["a"].v_max == 2.0
