"""Token counts with a public byte-level tokenizer."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies; the file is read on the driver and sent to the workers.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_ENCODERS: dict[str, object] = {}


def encoder(vocabulary: str, raw: bytes):
    """The encoder of a vocabulary, built once in each Python process."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def token_counter(spark: SparkSession, vocabulary: str = VOCABULARY):
    """A function Column -> Column: tokens of the whole text; 0 for NULL and for empty texts.

    The vocabulary (under 1 MB) is broadcast once; each worker builds its encoder on first use.
    """
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(vocabulary, sent.value).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    def tokens(text: Column) -> Column:
        return count(F.coalesce(text, F.lit("")))

    return tokens
