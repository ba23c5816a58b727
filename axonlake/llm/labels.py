"""Language and topic of whole documents from their token counts, for the cells of a mixture.

Both come from unigram models over the tokenizer's vocabulary. The language model is fitted to labelled documents and
refined by its own decisions, as labels may be wrong. The topic model is a mixture of unigrams without labels; a token
counts in it by how evenly the languages use it, so that topics are not languages over again. Sizes and labels come out
of one pass of the tokenizer over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from axonlake.llm.languages import LANGUAGES, label_code
from axonlake.llm.tokens import TOKENIZER, load_tokenizer


@dataclass(frozen=True)
class Labeller:
    """Frozen log2 probabilities per token: ``lang`` (vocabulary x languages) and ``topic`` (vocabulary x topics, weighted)."""

    languages: tuple
    lang: np.ndarray
    topic: np.ndarray
    prior: np.ndarray

    def label(self, ids: np.ndarray) -> tuple[str, str]:
        """``?`` for a text without tokens, or where there is no model."""
        if not len(ids):
            return "?", "?"
        language = self.languages[int(self.lang[ids].sum(axis=0).argmax())] if self.languages else "?"
        topic = f"t{int((self.prior + self.topic[ids].sum(axis=0)).argmax())}" if len(self.prior) else "?"
        return language, topic


def _log_parts(counts: np.ndarray, smooth: float = 0.1) -> np.ndarray:
    """log2 probabilities along the last axis, smoothed."""
    c = counts + smooth
    return np.log2(c) - np.log2(c.sum(axis=-1, keepdims=True))


def fit(ids: list[np.ndarray], codes: list[str | None], topics: int, rounds: int = 12) -> Labeller:
    """The models of sample documents (token ids each) with labels, of which some are None and some wrong."""
    docs = [(i, c) for i, c in zip(ids, codes) if len(i)]
    if not docs:
        return Labeller((), np.zeros((1, 0), np.float32), np.zeros((1, 0), np.float32), np.zeros(0))
    size = max(int(i.max()) for i, _ in docs) + 1
    # compact ids: the sample holds a small part of the vocabulary; the last row stands for every unseen token
    seen = np.unique(np.concatenate([i for i, _ in docs]))
    counts = np.zeros((len(docs), len(seen) + 1), np.float32)
    for d, (i, _) in enumerate(docs):
        at, n = np.unique(np.searchsorted(seen, i), return_counts=True)
        counts[d, at] = n
    langs = tuple(g for g in LANGUAGES if any(c == g for _, c in docs))
    chosen = np.array([langs.index(c) if c in langs else -1 for _, c in docs])
    model = np.zeros((len(seen) + 1, len(langs)), np.float32)
    weight = np.ones(len(seen) + 1, np.float32)
    if langs:
        for _ in range(3):
            per = np.stack([counts[chosen == j].sum(axis=0) for j in range(len(langs))])
            model = _log_parts(per).T.astype(np.float32)
            chosen = (counts @ model).argmax(axis=1)
        used = np.exp2(_log_parts(per))
        share = used / used.sum(axis=0)
        weight = (1 + (share * np.log2(share)).sum(axis=0) / np.log2(max(2, len(langs)))) if len(langs) > 1 else weight
        weight = np.clip(1 - weight, 0, 1) if len(langs) > 1 else weight  # 1: used alike in all languages, 0: in one only
        weight = (weight**4).astype(np.float32)
    x = counts * weight
    k = min(topics, len(docs))
    # seeds far apart: the document whose tokens the seeds so far explain worst
    p = _log_parts(x.sum(axis=0))[None, :]
    for _ in range(k):
        loss = -(x @ p.T).max(axis=1) / np.maximum(x.sum(axis=1), 1.0)
        p = np.vstack([p, _log_parts(x[int(loss.argmax())] + x.mean(axis=0))])
    p, prior = p[1:], np.full(k, -np.log2(k))
    for _ in range(rounds):
        score = x @ p.T + prior
        post = np.exp2(score - score.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        p, prior = _log_parts(post.T @ x), np.log2((post.sum(axis=0) + 1) / (len(docs) + k))
    lang, topic = np.zeros((size + 1, len(langs)), np.float32), np.zeros((size + 1, k), np.float32)
    lang[:], topic[:] = model[-1], 0.0
    lang[seen], topic[seen] = model[:-1], (p * weight).T[:-1]
    return Labeller(langs, lang, topic, prior)


def fit_labeller(docs: DataFrame, topics: int = 4, per_label: int = 150, most_chars: int = 4000, path: str = TOKENIZER) -> Labeller:
    """Fitted to a bounded sample: of each language label (and of the documents without one) the first ``per_label`` texts of
    at most ``most_chars`` characters by a hash. These parameters bound the rows sent to the driver."""
    given = docs.select(label_code(F.col("lang")).alias("_code"), F.col("text").alias("_text"), F.xxhash64("text", "doc_id").alias("_h")).where(F.length("_text").between(1, most_chars))
    first = given.withColumn("_n", F.row_number().over(W.partitionBy("_code").orderBy("_h"))).where(F.col("_n") <= per_label)
    rows = first.select("_code", "_text", "_h").toPandas().sort_values(["_h", "_text"])
    enc = load_tokenizer(path)
    return fit([np.array(enc.encode_ordinary(t), int) for t in rows["_text"]], [c if isinstance(c, str) else None for c in rows["_code"]], topics)


def sizes_and_labels(docs: DataFrame, labeller: Labeller, keep: tuple[str, ...] = ("doc_id", "source"), path: str = TOKENIZER) -> DataFrame:
    """``keep``, n_tokens, _lang and _topic of every row, whole texts in one pass. A null or empty text has no tokens and label ``?``."""
    bc = docs.sparkSession.sparkContext.broadcast(labeller)  # bounded by the vocabulary
    cols = list(keep)

    def work(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, model = load_tokenizer(path), bc.value
        last = len(model.lang) - 1
        for pdf in it:
            out = pdf[cols].reset_index(drop=True)
            sizes, pairs = [], []
            for t in pdf["_text"]:
                ids = np.array(enc.encode_ordinary(t), int) if isinstance(t, str) and t else np.zeros(0, int)
                sizes.append(len(ids))
                pairs.append(model.label(np.minimum(ids, last)))
            out["n_tokens"], out["_lang"], out["_topic"] = np.array(sizes, np.int64), [a for a, _ in pairs], [b for _, b in pairs]
            yield out

    given = docs.select(*cols, docs["text"].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema) + ", n_tokens long, _lang string, _topic string"
    return given.mapInPandas(work, schema)
