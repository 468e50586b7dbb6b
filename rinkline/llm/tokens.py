"""Sizes of texts in tokens of a public tokenizer; its vocabulary file is a parameter and stays where it is."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.operators.staging_area import staged

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def encoder(vocabulary: str):
    """The encoding of a rank file, read once per worker."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def sized(df: DataFrame, doc_id: str, text: str, source: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens)`` of every document, written once: whole texts; null and empty ones have 0 tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for pdf in batches:
            pdf["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf.pop("text")]
            yield pdf

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return staged(rows.mapInPandas(count, "doc_id long, source string, tokens long"), "tokens")
