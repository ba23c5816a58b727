"""Token counts under a public tokenizer whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
import sys
import types
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: A byte-level BPE vocabulary as ranks, read where the tasks run.
TOKENIZER = os.environ.get("AXONLAKE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: how this vocabulary's texts are cut before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str):
    """The encoder of a vocabulary file, loaded once per Python worker."""
    import tiktoken

    kept = sys.modules.setdefault("_axonlake_kept", types.ModuleType("_axonlake_kept"))
    if path not in kept.__dict__:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept.__dict__[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept.__dict__[path]


def token_counts(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and n_tokens (long) of every row. A null text has none, an empty one neither; special tokens are plain text."""
    cols = list(keep)

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load_tokenizer(path)
        for pdf in it:
            pdf = pdf.reset_index(drop=True)
            out = pdf[cols].copy()
            out["n_tokens"] = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in pdf["_text"]]
            yield out

    given = docs.select(*cols, docs[text].alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema) + ", n_tokens long"
    return given.mapInPandas(count, schema)
