"""Embedding of texts by a pluggable function over Arrow batches; offline, by hashed tokens."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import TOKEN
from .vectors import normalised

DIMS = 64


def hashing(texts: list[str], dims: int = DIMS) -> np.ndarray:
    """Counts of tokens in hashed buckets, with hashed signs: the same text gives the same vector everywhere."""
    out = np.zeros((len(texts), dims))
    token = regex.compile(TOKEN)
    for i, t in enumerate(texts):
        for w in token.findall(t.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % dims] += 1 if h >> 31 else -1
    return out


def embed(df: DataFrame, text: str = "document", into: str = "embedding", embedder: Callable[[list[str]], np.ndarray] = hashing, prefix: str = "") -> DataFrame:
    """Adds the embedder's vectors at unit length; zero vectors stay zero, null texts count as empty.

    *prefix* is what some models want before documents or before questions. The embedder is called once a batch.
    """

    @F.pandas_udf("array<double>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(embedder([prefix + (t or "") for t in batch])))

    return df.withColumn(into, made(F.col(text))).withColumn(into, normalised(F.col(into)))
