"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import spread

#: byte-level BPE ranks; the folder is a parameter so that a cluster can keep it elsewhere
RANKS = os.path.join(os.environ.get("TEXTQUARRY_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken")
# Fixed value: the split pattern of the public byte-level vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[str, object] = {}


def encoding(path: str = RANKS):
    """The tokenizer at ``path``, loaded once for each Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        _encodings[path] = tiktoken.Encoding(
            os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _encodings[path]


def token_counts(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), path: str = RANKS) -> DataFrame:
    """(key, *keep, tokens) of each row; a null text has 0 tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(path)
        for b in batches:
            out = b[["key", *keep]].copy()
            out["tokens"] = [0 if t is None else len(enc.encode_ordinary(t)) for t in b["_text"]]
            yield out

    kinds = dict(df.dtypes)
    cols = [F.col(key).alias("key"), *(F.col(c) for c in keep), F.col(text).alias("_text")]
    schema = ", ".join([f"key {kinds[key]}", *(f"`{c}` {kinds[c]}" for c in keep), "tokens bigint"])
    return spread(df.select(*cols)).mapInPandas(run, schema)
