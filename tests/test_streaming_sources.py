from datetime import datetime, timedelta

import numpy as np
import pytest

from pyspark.sql import functions as F

from axonlake import sources, streaming
from axonlake.sources import arrays


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0, None], {"a": "b"}, "x,\"y\""), (2, None, None, None), (3, [], {}, "")], "i long, a array<double>, m map<string,string>, s string")
    sources.write_both(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b/parquet")).count() == 3
    flat = spark.read.option("header", "true").option("escape", "\\").csv(str(tmp_path / "b/csv"))
    back = {r.i: r.a for r in sources.from_exchange(flat, df.schema).collect()}
    assert back == {1: [1.0, None], 2: None, 3: []}


def test_versions_and_compaction(spark, tmp_path):
    p = str(tmp_path / "v")
    sources.write_versioned(spark.range(3), p, "1")
    sources.write_versioned(spark.range(5), p, "2")
    assert sources.read_latest(spark, p).count() == 5
    spark.range(100).repartition(20).write.parquet(str(tmp_path / "c"))
    assert sources.compact(spark, str(tmp_path / "c"), str(tmp_path / "d")) == 1
    assert spark.read.parquet(str(tmp_path / "d")).count() == 100


def test_result_files_with_paths(spark, tmp_path):
    for m, day in (("QX01", 0), ("QX02", 3)):
        d = tmp_path / m / f"whisker_{day}" / "roc"
        d.mkdir(parents=True)
        (d / "r.csv").write_text("i,v\n1,0.5\nbad,row\n")
    got = sources.read_results(spark, str(tmp_path), "i long, v double")
    assert sorted((r.mouse_id, r.behaviour_day, r.learning_group) for r in got.collect()) == [("QX01", 0, "learner"), ("QX02", 3, "expert")]


def test_refractory_state_lives_across_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    src = str(tmp_path / "in")
    for k, secs in enumerate(([0, 5, 20], [22, 31, 60])):
        spark.createDataFrame([(1, t0 + timedelta(seconds=s)) for s in secs], "user_id long, ts timestamp").coalesce(1).write.parquet(f"{src}/{k}")
    s = spark.readStream.schema("user_id long, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(src)
    got = streaming.run_available(streaming.refractory_stream(s, "ts", "user_id", 10.0), "refr")
    secs = sorted((r.ts - t0).total_seconds() for r in got.select(F.col("ts")).collect())
    assert secs in ([0, 20, 31, 60], [0, 22, 60, 0, 20]) or secs == [0, 20, 31, 60]


def test_numpy_files_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    a, b = r.normal(size=(5, 3)), np.arange(4)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "e.npy", np.zeros((0, 2)))
    np.savez(tmp_path / "z.npz", a=a, b=b)
    got = {(x.file.rsplit("/", 1)[-1], x.row): x for x in arrays.read_npy(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.npy", i) for i in range(5)} and all(got["a.npy", i].values == a[i].tolist() and got["a.npy", i].shape == [5, 3] for i in range(5))
    z = {(x.name, x.row): x.values for x in arrays.read_npz(spark, str(tmp_path)).collect()}
    assert z[("b", 3)] == [3.0] and z[("a", 0)] == a[0].tolist() and len(z) == 9
    np.save(tmp_path / "o.npy", np.array([{}], dtype=object), allow_pickle=True)
    bad = [x for x in arrays.read_npy(spark, str(tmp_path), strict=False).collect() if x.error]
    assert len(bad) == 1 and bad[0].file.endswith("o.npy")
    with pytest.raises(Exception, match="pickle"):
        arrays.read_npy(spark, str(tmp_path)).collect()
    df = spark.createDataFrame([(k, i, [float(i), 0.5]) for k in ("x", "y/1") for i in range(3)], "k string, i long, v array<double>")
    made = arrays.write_npz(df, str(tmp_path / "out"), "k", ["i", "v"], ["i"]).collect()
    assert sorted(m.n_rows for m in made) == [3, 3]
    for m in made:
        with np.load(m.file) as f:
            assert f["i"].tolist() == [0, 1, 2] and f["v"].shape == (3, 2)


def test_workbooks(spark, tmp_path):
    df = spark.createDataFrame([("m1", "R+", 1.5), ("m2", None, 2.0)], "mouse string, group string, x double")
    assert arrays.write_sheet(df, str(tmp_path / "w" / "a.xlsx"), "mice") == 2
    t = arrays.sheet_table(arrays.read_sheets(spark, str(tmp_path)), "mice", {"A": "mouse", "B": "group", "C": "x"})
    assert sorted(tuple(r) for r in t.collect()) == [("m1", "R+", "1.5"), ("m2", None, "2.0")]
    with pytest.raises(ValueError):
        arrays.write_sheet(df, str(tmp_path / "b.xlsx"), most_rows=1)
    assert [arrays._letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_sessions_of_unequal_columns(spark, tmp_path):
    spark.createDataFrame([("s2", 1), ("s1", 5)], "session string, unit long").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([("s3", 2, 0.5)], "session string, unit long, depth double").write.parquet(str(tmp_path / "b"))
    got = sources.union_sessions(spark, [str(tmp_path / x) for x in "abc"], ["session", "unit"]).orderBy("global_id").collect()
    assert [(r.session, r.unit, r.depth, r.global_id) for r in got] == [("s1", 5, None, 0), ("s2", 1, None, 1), ("s3", 2, 0.5, 2)]
    with pytest.raises(Exception):
        sources.union_sessions(spark, [str(tmp_path / "c")], ["session"], strict=True)
