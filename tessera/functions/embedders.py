"""Embedders by name; the hashed bag of words needs no model."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed_words(text: str, dim: int = 384) -> list[float]:
    """The same vector as functions.vectors.hash_embedding, dense."""
    out = [0.0] * dim
    for word in re.findall("[a-z0-9]+", text.lower()):
        h = 2166136261
        for c in word:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        out[h % dim] += 1
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


Embed = Callable[[list[str]], list[list[float]]]
_KNOWN: dict[str, Embed] = {"hashed-words-384": lambda texts: [hashed_words(t) for t in texts]}


def register(name: str, embed: Embed) -> None:
    _KNOWN[name] = embed


def embedder(name: str) -> Embed:
    if name not in _KNOWN:
        raise LookupError(f"no embedder called {name}")
    return _KNOWN[name]


def with_embedding(rows: DataFrame, text: str, name: str, batch: int = 32, into: str = "embedding") -> DataFrame:
    """Rows with the vector of a text, embedded in small batches."""
    embed = embedder(name)

    @F.pandas_udf("array<float>")
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            texts = s.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embed(texts[i : i + batch])])

    return rows.withColumn(into, vectors(text))


def refreshed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Rows whose vectors are of another model, embedded anew; the rest as they are."""
    old = rows.filter(~F.col("embedding_model").eqNullSafe(F.lit(name)))
    new = with_embedding(old.drop("embedding"), text, name).withColumn("embedding_model", F.lit(name))
    return rows.filter(F.col("embedding_model").eqNullSafe(F.lit(name))).unionByName(new.select(*rows.columns))
