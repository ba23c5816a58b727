import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.llm import mixing, packing
from axonlake.llm.tokens import TOKENIZER, load_tokenizer, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary here")


def brute_sum_of_squares(sizes, capacity):
    gaps, out = [], []
    for s in sizes:
        if s == 0:
            out.append(max(0, len(gaps) - 1))
            continue
        best = None
        for b in [*range(len(gaps)), len(gaps)]:
            g = gaps[b] if b < len(gaps) else capacity
            if g < s:
                continue
            new = [x for i, x in enumerate(gaps) if i != b] + [g - s]
            counts = np.bincount([x for x in new if x > 0], minlength=1)
            key = (int((counts.astype(np.int64) ** 2).sum()), g if b < len(gaps) else capacity + 1, b)
            if best is None or key < best[0]:
                best = (key, b, g)
        _, b, g = best
        if b == len(gaps):
            gaps.append(capacity - s)
        else:
            gaps[b] -= s
        out.append(b)
    return out, gaps


def test_rule_against_brute_force():
    g = random.Random(1)
    for _ in range(20):
        cap = g.choice([10, 24])
        sizes = [g.randint(0, cap) for _ in range(60)]
        bins, at = packing.sum_of_squares(np.array(sizes), cap)
        want, gaps = brute_sum_of_squares(sizes, cap)
        used = np.bincount(bins, weights=sizes, minlength=len(gaps))
        assert sorted(used) == sorted(cap - np.array(gaps))  # bins of one gap are interchangeable
        for b in set(bins.tolist()):
            spans = sorted((int(at[i]), int(at[i]) + sizes[i]) for i in range(60) if bins[i] == b and sizes[i])
            assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:])) and (not spans or spans[-1][1] <= cap)


def test_every_document_is_packed_once(spark):
    enc = load_tokenizer(TOKENIZER)
    g = random.Random(2)
    texts = [None, "", "   ", "one <|endoftext|> two"] + [" ".join(g.choice(["axon", "spike", "trial", "lick"]) for _ in range(g.choice([1, 5, 60, 300, 700]))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null id", "x", 1)], "doc_id long, text string, sequence string, size int")
    cap = 128
    p = packing.pack(df, capacity=cap, shard_items=60).toPandas()
    n = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    for i, c in n.items():
        q = p[p.doc_id == i].sort_values("piece")
        assert q["size"].sum() == c and len(q) == max(1, -(-c // cap)) and list(q.first_token) == [k * cap for k in range(len(q))]
    assert p.doc_id.isna().sum() == 1
    fill = p.groupby("sequence")["size"].sum()
    assert fill.max() <= cap
    for _, s in p[p["size"] > 0].sort_values("at").groupby("sequence"):
        assert (s["at"].to_numpy()[1:] >= (s["at"] + s["size"]).to_numpy()[:-1]).all()
    r = packing.fill_report(packing.pack(df, capacity=cap), cap).first()
    assert r.filled > 0.9 and r.max_used <= cap
    assert packing.pack(df.limit(0)).count() == 0


def test_counts_are_the_tokenizer_s(spark):
    df = spark.createDataFrame([(1, "Hello  wörld\n42"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts(df).collect()} == {1: len(load_tokenizer(TOKENIZER).encode_ordinary("Hello  wörld\n42")), 2: 0}


def docs(spark, n=3000):
    g = random.Random(3)
    rows = [(i, " ".join(["spike"] * g.choice([5, 20, 80])) + g.choice(["", " CA1", " VPM", " MOp"]), g.choices(["big", "mid", "tiny", None, "other"], [60, 30, 2, 4, 4])[0], g.choice(["en", "fr", None, "xx"])) for i in range(n)]
    rows += [(n, None, "mid", "en"), (n + 1, "", "mid", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("copies", F.lit("clash")).withColumn("weight", F.lit(9))


def test_shares_caps_and_shortfall(spark):
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 2), ("tiny", 0.15, 3), ("none", 0.05, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    d = docs(spark)
    uses, report = mixing.mix(d, t)
    r = {x.source: x for x in report.collect()}
    u = uses.toPandas()
    assert set(r) == {"big", "mid", "tiny", "none"} and set(u.source) == {"big", "mid", "tiny"}
    caps = {"big": 1, "mid": 2, "tiny": 3}
    assert all(u[u.source == s].copies.max() <= c for s, c in caps.items())
    for s in ("big", "mid"):
        assert r[s].shortfall == 0 and abs(r[s].actual_tokens - r[s].target_tokens) < 0.03 * r[s].target_tokens
    assert r["tiny"].shortfall > 0 and r["tiny"].actual_tokens == r["tiny"].available
    assert r["none"].shortfall > 0 and r["none"].available == 0
    again = mixing.mix(d.repartition(11), t)[0].toPandas()
    assert sorted(map(tuple, again.values)) == sorted(map(tuple, u.values))


def test_feasible_budget_reaches_the_shares(spark):
    t = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.4, 2), ("tiny", 0.1, 3)], "source string, target_share double, max_repeats int")
    for x in mixing.mix(docs(spark), t, budget="feasible")[1].collect():
        assert abs(x.actual_share - x.target_share) < 0.02


def test_empty_tables(spark):
    t = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    uses, report = mixing.mix(docs(spark).limit(0), t)
    assert uses.count() == 0 and [x.actual_tokens for x in report.collect()] == [0]
    uses, report = mixing.mix(docs(spark, 50), t.limit(0))
    assert uses.count() == 0 and report.count() == 0


def test_raking_keeps_margins_where_there_is_room():
    import pandas as pd

    cells = pd.DataFrame([("a", "en", 100.0), ("a", "fr", 300.0), ("b", "en", 300.0), ("b", "fr", 100.0)], columns=["source", "lang", "tokens"])
    w = mixing.rake(cells, {"a": (0.5, 10), "b": (0.5, 10)}, 800.0, ["lang"])
    got = (w * cells.tokens).groupby(cells.source).sum()
    assert abs(got["a"] - 400) < 1e-3 and abs(got["b"] - 400) < 1e-3
    lang = (w * cells.tokens).groupby(cells.lang).sum()
    assert abs(lang["en"] - 400) < 1


def test_used_up_sources_come_from_the_draw(spark):
    t = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 2), ("tiny", 0.15, 3), ("none", 0.05, 2), ("other", 0.0, 0)], "source string, target_share double, max_repeats int")
    report = mixing.mix(docs(spark), t)[1]
    assert {r.source for r in mixing.exhausted(report).collect()} == {"tiny", "none"} == {r.source for r in report.where("shortfall > 0").collect()}
    assert "copies" in report._jdf.queryExecution().optimizedPlan().toString() and "Window" in mixing.exhausted(report)._jdf.queryExecution().optimizedPlan().toString()


def test_marginals_are_reached_where_there_is_room(spark):
    t = spark.createDataFrame([("big", 0.5, 3), ("mid", 0.5, 3)], "source string, target_share double, max_repeats int")
    m = mixing.plan(docs(spark), t, budget="feasible")[2].toPandas()
    assert set(m.margin) == {"source", "lang", "topic"}
    assert (m[m.margin == "source"].residual.abs() < 1e-6).all()
    assert (m.groupby("margin")[["wanted", "expected"]].sum() - 1).abs().to_numpy().max() < 1e-6


def test_topics_are_not_languages():
    from axonlake.llm import labels

    g = np.random.default_rng(5)
    words = {"en": np.arange(0, 50), "fr": np.arange(50, 100)}  # tokens of one language
    themes = [np.arange(100, 120), np.arange(120, 140)]  # tokens that all languages share
    ids, codes, truth = [], [], []
    for i in range(300):
        lang, k = ("en", "fr")[i % 2], (i // 2) % 2
        ids.append(np.concatenate([g.choice(words[lang], 60), g.choice(themes[k], 15)]))
        codes.append(lang if g.random() > 0.2 else ("fr" if lang == "en" else None))
        truth.append((lang, k))
    model = labels.fit(ids, codes, 2)
    got = [model.label(x) for x in ids]
    assert np.mean([a[0] == b[0] for a, b in zip(got, truth)]) > 0.98
    same = np.mean([(a[1] == "t0") == (b[1] == 0) for a, b in zip(got, truth)])
    assert max(same, 1 - same) > 0.95
    assert model.label(np.zeros(0, int)) == ("?", "?") and labels.fit([], [], 3).label(np.array([0])) == ("?", "?")


def test_rows_of_one_id_are_documents_of_their_own(spark):
    df = spark.createDataFrame([(7, "axon " * 60)] * 4 + [(8, "spike " * 300)] * 2, "doc_id long, text string")
    p = packing.pack(df, capacity=128, shard_items=2)
    assert {r.doc_id for r in p.where("piece > 0").collect()} == {8}
    assert packing.fill_report(p, 128).first().max_used <= 128
