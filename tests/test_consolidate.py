import json
from datetime import datetime, timedelta

from axonlake.operators import consolidate as con

SCHEMA = "file_id long, file_path string, mouse_id string, written_at timestamp_ntz, n_bytes long, body string"


def line(n, score=0.5, style=0):
    o = {"neuron_id": n, "model_name": "full", "lambda_opt": 0.1, "train_score": score, "test_score": 0.25, "test_corr": 0.125}
    if style == 1:
        o = dict(reversed(o.items()))
    text = json.dumps(o)
    return text.replace("0.25", "2.500e-01") if style == 2 else text


def files(spark, specs):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([(f, p, m, at + timedelta(hours=h) if h is not None else None, len(b or ""), b) for f, p, m, h, b in specs], SCHEMA)


P = "results/QX1/models/4e7ff98_model_full_fold2_results.jsonl"


def repeats(spark, specs, **kw):
    merged = con.settle_heads(con.merge_runs(con.parse_result_files(files(spark, specs)), **kw))
    return sorted(tuple(r) for r in merged.where("repeat").select("file_id", "line_no").collect()), merged


def test_repeats_whatever_the_spelling(spark):
    specs = [
        (5, P, "m", 1, line(1) + "\n" + line(2) + "\n"),
        (1, P.replace("/", "\\").replace("full", "Full").replace("fold2", "fold_02"), "m", 2, line(1, style=1) + "\n\n" + line(2, style=2)),
        (2, P.replace("fold2", "fold3"), "m", 3, line(1)),  # another fold
        (3, P, "m", 4, line(1, 0.75) + "\n" + line(2)[:30]),  # other score; a torn line
        (4, P, "other", 5, line(1) + "\n" + line(1)),
        (6, P, "m", 6, ""), (7, P, "m", 7, None), (8, None, "m", 8, line(3)), (9, P, None, None, line(9) + "\n" + line(9)),
    ]
    got, merged = repeats(spark, specs)
    assert got == [(1, 1), (1, 3), (4, 2), (9, 2)]
    assert merged.count() == 2 + 2 + 1 + 1 + 2 + 1 + 2


def test_a_hot_record_spans_ranges(spark):
    specs = [(i, P, "m", i, line(1)) for i in range(200)] + [(1000 + i, P, "m", i, line(i + 2)) for i in range(50)]
    got, merged = repeats(spark, specs, ranges=13)
    assert got == [(i, 1) for i in range(1, 200)]
    assert merged.select("range_id").distinct().count() > 5


def test_rolls_by_bytes_and_keeps_every_record(spark):
    specs = [(i, P, "m", i, "\n".join(line(100 * i + k) for k in range(20))) for i in range(10)] + [(99, P, "m", 99, line(101))]
    got, merged = repeats(spark, specs, target_bytes=2000, ranges=2)
    assert got == [(99, 1)]
    m = con.manifest(merged).toPandas()
    assert m.n_records.sum() == 200 and m.n_repeats.sum() == 1 and len(m) > 4
    assert m.n_bytes.max() <= 2000 + 400


def test_empty(spark):
    assert repeats(spark, [])[0] == []


def test_written_once(spark, tmp_path):
    specs = [(i, P, "m", i, line(i % 7)) for i in range(30)]
    merged = con.consolidate(files(spark, specs))
    con.write_consolidated(merged, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 7 and back.select("neuron_id").distinct().count() == 7


def test_few_files_of_the_target_size(spark, tmp_path):
    """1,500 tiny files become ceil(bytes / target) files at any shuffle setting, each a range of its own with its metadata."""
    specs = [(i, P.replace("fold2", f"fold{i % 5}"), f"m{i % 3}", i, "\n".join(line(100 * i + k, score=0.1 * k + i) for k in range(4))) for i in range(1500)] + [(2000 + i, P, "m0", 2000 + i, line(0, score=0.0)) for i in range(400)]
    want = {(r.mouse_id, r.fold, r.neuron_id, r.train_score) for r in con.parse_result_files(files(spark, specs)).collect()}
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("3", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            merged = con.consolidate(files(spark, specs), 30_000)
            size = merged.where("not repeat").agg({"out_file": "max"}).first()[0] + 1
            out = str(tmp_path / parts)
            ranges = con.write_consolidated(merged, out).collect()
            assert len(ranges) == size == len(list((tmp_path / parts).glob("*.parquet")))
            assert sum(r.n_records for r in ranges) == len(want) and size > 1
            held = sorted(((r.first_key, r.last_key) for r in ranges), key=str)
            assert all(tuple(a[1]) <= tuple(b[0]) for a, b in zip(held, held[1:]))
            assert max(r.n_records for r in ranges) < 1.3 * min(r.n_records for r in ranges)
            back = spark.read.parquet(out)
            assert {(r.mouse_id, r.fold, r.neuron_id, r.train_score) for r in back.collect()} == want and back.count() == len(want)
            assert con.write_consolidated(con.consolidate(files(spark, specs)), out + "-one").count() == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
