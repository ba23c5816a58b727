"""Sources mixed to target shares of tokens by raking, with a cap on how often a document is used.

Tokens are summed per cell of source, language and topic, both fitted to the texts (``labels``), as the documents' own language
labels are often missing or wrong. The cells' weights (expected uses of each document) are raked
by iterative proportional fitting to the marginals, under the cap of each source; documents are then drawn
systematically with these weights in the order of a hash of their id, so the draw is repeatable and close to its expectation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.llm.labels import fit_labeller, sizes_and_labels
from axonlake.llm.tokens import TOKENIZER
from axonlake.session import materialise

def rake(cells: pd.DataFrame, targets: dict[str, tuple[float, float]], total: float, margins: list[str], rounds: int = 200) -> np.ndarray:
    """Expected uses per cell. ``cells`` has source, the margins' columns and tokens; ``targets`` share and cap per source.

    The source shares are binding up to what the caps allow; the other margins keep the corpus's own shares as far as the
    sources leave room. Sources without a target get weight 0.
    """
    tok = cells["tokens"].to_numpy(float)
    src = cells["source"].to_numpy()
    cap = np.array([targets[s][1] if s in targets else 0.0 for s in src])
    w = np.where(cap > 0, 1.0, 0.0)
    want = {s: min(share * total, float((tok * cap)[src == s].sum())) for s, (share, _) in targets.items()}
    corpus = {m: cells.groupby(m, dropna=False)["tokens"].sum() for m in margins}
    allowed = sum(want.values())

    def fit_sources(w: np.ndarray) -> np.ndarray:
        for s, goal in want.items():
            at = src == s
            if goal >= float((tok * cap)[at].sum()) * (1 - 1e-12):  # all that there is: every document at its cap, exactly
                w = np.where(at, cap, w)
                continue
            for _ in range(50):  # a capped cell gives its rest to the others of its source
                free = at & (w < cap)
                have, need = (w * tok)[free].sum(), goal - (w * tok)[at & ~free].sum()
                if have <= 0 or abs(have - need) <= 1e-9 * max(goal, 1.0):
                    break
                w = np.where(free, np.minimum(w * max(need, 0.0) / have, cap), w)
            w = np.where(at, np.minimum(w, cap), w)
        return w

    w = fit_sources(w)
    for _ in range(rounds):
        old = w
        for m in margins:
            share = corpus[m] / max(corpus[m].sum(), 1.0)
            have = pd.Series(w * tok).groupby(cells[m].to_numpy(), dropna=False).sum()
            ratio = cells[m].map((share * allowed / have.replace(0, np.nan)).clip(0.25, 4)).fillna(1.0).to_numpy(float)
            w = np.minimum(w * ratio, cap)
        w = fit_sources(w)
        if np.abs(w - old).max(initial=0.0) < 1e-9:
            break
    return w


def margins(cells: pd.DataFrame, w: np.ndarray, targets: dict[str, tuple[float, float]], total: float, names: list[str]) -> pd.DataFrame:
    """margin, value, wanted, expected, residual: how near the weights come to each marginal, as parts of the mix.

    The wanted share of a source is its target's, of the other margins the corpus's own. ``residual`` is expected less wanted;
    what remains is what the caps or other margins do not allow.
    """
    tok = cells["tokens"].to_numpy(float)
    reached = max(float((w * tok).sum()), 1e-300)
    out = [("source", s, share, float((w * tok)[cells["source"].to_numpy() == s].sum()) / reached) for s, (share, _) in targets.items()]
    for m in names:
        corpus = cells.groupby(m, dropna=False)["tokens"].sum()
        for v, t in corpus.items():
            out.append((m.lstrip("_"), v, float(t) / max(float(corpus.sum()), 1.0), float((w * tok)[cells[m].to_numpy() == v].sum()) / reached))
    f = pd.DataFrame(out, columns=["margin", "value", "wanted", "expected"])
    f["residual"] = f["expected"] - f["wanted"]
    return f


def _draw(sized: DataFrame, n_docs: int, seed: int, stratum_docs: int = 20000) -> DataFrame:
    """``sized`` (with weight) and copies: a systematic draw of the expected uses within each source, in order of size.

    Along the documents of a source by size, each gets the whole numbers that the running sum of weights passes there, from
    a random start. So all sizes are drawn in proportion, and no document gets more than its weight rounded up. A hash of
    the id cuts sources into parts of at most about ``stratum_docs`` documents, each drawn by itself.
    """
    parts = max(1, -(-n_docs // stratum_docs))
    x = sized.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))).withColumn("_part", F.pmod("_h", F.lit(parts)))
    start = F.pmod(F.xxhash64("source", "_part", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    upto = F.sum("weight").over(W.partitionBy("source", "_part").orderBy("n_tokens", "_h", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("_upto", F.coalesce(upto, F.lit(0.0)) + start)
    return x.withColumn("copies", (F.floor(F.col("_upto") + F.col("weight")) - F.floor("_upto")).cast("int")).drop("_h", "_part", "_upto")


def mix(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, budget: float | str = "corpus", seed: int = 42, max_cells: int = 100_000, topics: int = 4) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (doc_id, source, n_tokens, copies > 0) and the report per source.

    ``targets`` (source, target_share, max_repeats) is a parameter table. ``budget``: the size of the mix in tokens;
    ``corpus`` is that of all documents, ``feasible`` the largest at which every source that has documents reaches its share,
    so that the shares come out as wanted. Report: source, target_share, max_repeats, n_docs, n_tokens, available (tokens at
    max_repeats), target_tokens, shortfall (target above available), expected_tokens, actual_tokens, min_copies, max_copies,
    actual_share (of the mix). A source without documents has size 0. Null sources and sources without a target are never
    drawn but count in the corpus. Null or empty texts have no tokens and are drawn like their cell. A document is never
    used more than its source's ``max_repeats``. Target rows with a null source, share or cap are left out; of repeated ones
    one counts. Rows with equal doc_id are drawn each.

    The cells (sources with a target x languages x ``topics``) are few whatever the corpus; more than ``max_cells`` is an
    error. Calling this runs the passes that size the texts and sum the cells; the draw itself runs with the result.
    """
    return plan(docs, targets, path, budget, seed, max_cells, topics)[:2]


def plan(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, budget: float | str = "corpus", seed: int = 42, max_cells: int = 100_000, topics: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``mix`` and, third, the marginals: margin, value, wanted, expected, residual (see ``margins``)."""
    spark = docs.sparkSession
    # sized and labelled once, for the cells and for the draw: the counts are tiny beside the texts
    sized = materialise(sizes_and_labels(docs, fit_labeller(docs, topics, path=path), ("doc_id", "source"), path), "tokens")
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).dropna().dropDuplicates(["source"])
    rows = t.limit(max_cells + 1).toPandas().sort_values("source")
    if len(rows) > max_cells:
        raise ValueError("too many target sources")
    goal = {r.source: (r.target_share, float(r.max_repeats)) for r in rows.itertuples()}
    known = F.when(F.col("source").isin(list(goal)), F.col("source"))
    keys = ["source", "_lang", "_topic"]
    cell = sized.groupBy(known.alias("source"), "_lang", "_topic").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")).limit(max_cells + 1).toPandas()
    if len(cell) > max_cells:
        raise ValueError("too many cells")
    corpus = float(cell["tokens"].sum())
    inside = cell[cell["source"].notna()].sort_values(keys).reset_index(drop=True)
    held = inside.groupby("source")["tokens"].sum()
    if budget == "feasible":
        total = min([float(held[s]) * cap / share for s, (share, cap) in goal.items() if share > 0 and held.get(s, 0) > 0], default=0.0)
    else:
        total = corpus if budget == "corpus" else float(budget)
    inside["weight"] = rake(inside, goal, total, ["_lang", "_topic"])
    values = list(inside[[*keys, "weight"]].itertuples(index=False, name=None))
    weights = spark.createDataFrame(values, "source string, _lang string, _topic string, weight double")
    drawn = _draw(sized.join(F.broadcast(weights), keys), int(cell["n_docs"].sum()), seed)  # at most max_cells rows are broadcast
    uses = drawn.where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    got = drawn.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_tokens") * F.col("weight")).alias("expected_tokens"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.min("copies").alias("min_copies"), F.max("copies").alias("max_copies"),
    )
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_docs", "n_tokens", "actual_tokens", "min_copies", "max_copies")]
    r = t.join(got, "source", "left").select("source", "target_share", "max_repeats", *zero, F.coalesce("expected_tokens", F.lit(0.0)).alias("expected_tokens"))
    r = r.withColumn("available", F.col("n_tokens") * F.col("max_repeats")).withColumn("target_tokens", F.col("target_share") * F.lit(total))
    r = r.withColumn("shortfall", F.greatest(F.col("target_tokens") - F.col("available"), F.lit(0.0)))
    whole = F.sum("actual_tokens").over(W.partitionBy(F.lit(1)))  # one row per target source
    left = margins(inside, inside["weight"].to_numpy(float), goal, total, ["_lang", "_topic"])
    shares = spark.createDataFrame(list(left.itertuples(index=False, name=None)), "margin string, value string, wanted double, expected double, residual double")
    return uses, r.withColumn("actual_share", F.col("actual_tokens") / F.greatest(whole, F.lit(1))), shares


def exhausted(report: DataFrame) -> DataFrame:
    """The sources of a report that the draw used up without reaching the target: every document drawn as often as allowed (or
    none there), and yet fewer tokens than the target."""
    return report.where(((F.col("n_docs") == 0) | (F.col("min_copies") >= F.col("max_repeats"))) & (F.col("actual_tokens") < F.col("target_tokens"))).select("source")
