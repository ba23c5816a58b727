"""Texts of varying length packed into sequences of fixed capacity by the sum-of-squares rule.

Only a text above the capacity is split: into full sequences of its own and a rest. Texts and rests go to shards by a
hash of a row number, not of their id, so rows of one id spread too; each shard is of about ``shard_items`` items however large the input is; every shard is packed by itself, and
its few half-filled last sequences are the only loss of not packing all in one place.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from axonlake.llm.tokens import TOKENIZER, token_counts
from axonlake.session import materialise


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A bin and an offset for each item, in the given order.

    Each item goes where the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of open bins with g tokens
    left; a full bin counts nowhere. Of equal places the smallest gap is taken, a new bin last. Items of size 0 go to the
    bin opened last (bin 0 if there is none).
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # count[0] stays 0: full bins
    open_: list[deque] = [deque() for _ in range(capacity + 1)]
    made = 0
    for i, s in enumerate(sizes.tolist()):
        if s == 0:
            bins[i] = max(0, made - 1)
            continue
        # moving a bin from gap g to g - s changes the sum by 2 (N(g - s) - N(g)) + 2, filling it by 1 - 2 N(g)
        gaps = count[s:capacity]
        best_g, best = -1, 2 * count[capacity - s] + 1 if s < capacity else 0
        if len(gaps) and gaps.any():
            change = 2 * (count[: capacity - s] - gaps) + 2
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = 1 << 40
            j = int(change.argmin())
            if change[j] <= best:
                best_g = j + s
        if best_g < 0:
            b, g = made, capacity
            made += 1
        else:
            b, g = open_[best_g].popleft(), best_g
            count[g] -= 1
        bins[i], offsets[i] = b, capacity - g
        left = g - s
        if left:
            open_[left].append(b)
            count[left] += 1
    return bins, offsets


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", capacity: int = 2048, shard_items: int = 20000, path: str = TOKENIZER) -> DataFrame:
    """One row per piece of a document: id, n_tokens (of the document), piece (from 0), first_token, size, sequence, at.

    ``sequence`` names the container and ``at`` the piece's first place in it. Every document is in the result, split only
    if it exceeds ``capacity``: its full pieces are sequences of their own, its rest is packed. Null and empty texts have
    size 0 and take no space. Rows with equal ids are documents of their own; a null id is kept. Empty input gives no rows.

    Calling this runs the tokenizer once over all texts and writes the sizes to the shared folder; packing runs with the result.
    """
    # tokenised once: the sizes, with a row number that stays the same in every later pass
    sized = materialise(token_counts(docs, text, (id_col,), path).withColumn("_row", F.monotonically_increasing_id()), "sizes")
    full = F.floor(F.col("n_tokens") / capacity)
    pieces = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1))
    items = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)))
    items = items.withColumn("first_token", F.col("piece") * capacity).withColumn("size", F.least(F.col("n_tokens") - F.col("first_token"), F.lit(capacity).cast("long")))
    whole = items.where((F.col("piece") < full)).withColumn("sequence", F.concat_ws("-", F.lit("own"), F.col("_row").cast("string"), F.col("piece").cast("string"))).withColumn("at", F.lit(0).cast("long"))
    n = sized.count()  # one number, from the sizes
    shards = max(1, -(-n // shard_items))
    rest = items.where(F.col("piece") >= full).withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int"))
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.drop("_row").schema) + ", piece long, first_token long, size long, sequence string, at long"
    names = [id_col, "n_tokens", "piece", "first_token", "size"]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        # long items first: the short ones then close the gaps that are left
        pdf = pdf.sort_values(["size", id_col], ascending=[False, True], kind="stable")
        bins, at = sum_of_squares(pdf["size"].to_numpy(), capacity)
        out = pdf[names].copy()
        shard = int(pdf["_shard"].iloc[0])
        out["sequence"] = [f"{shard}-{b}" for b in bins.tolist()]
        out["at"] = at
        return out

    return rest.groupBy("_shard").applyInPandas(fill, out_schema).unionByName(whole.select(*names, "sequence", "at"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: sequences, pieces, tokens and the filled part of all capacity."""
    per = packed.where("size > 0").groupBy("sequence").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_sequences"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.max("used").alias("max_used"), (F.sum("used") / (F.count("*") * capacity)).alias("filled"))
