"""Turning text into vectors: built-in hashed bags or a caller's model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import vectors

# A model: from a list of texts to a list of equally long vectors. An embedder
# maps a text column to a vector column.
Encode = Callable[[list[str]], list[list[float]]]


def hashed_embedder(dim: int = vectors.DEFAULT_DIM) -> Callable[[Column], Column]:
    """Weight-free default embedding that stays inside the JVM."""
    return lambda text: vectors.hashed_bag(text, dim)


def model_embedder(load: Callable[[], Encode]) -> Callable[[Column], Column]:
    """Wrap a model. ``load`` runs once per task, then batches stream through."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in model(texts.fillna("").tolist())])

    return encode


PROVIDERS: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "hashed": hashed_embedder,
    "model": model_embedder,
}


def create_embedder(provider: str, **options) -> Callable[[Column], Column]:
    """Embedder by provider name; an unknown name is an error."""
    if provider not in PROVIDERS:
        raise ValueError(f"Unsupported embedding provider: {provider}")
    return PROVIDERS[provider](**options)


def embed(
    df: DataFrame,
    text_col: str = "content",
    vector_col: str = "embedding",
    embedder: Callable[[Column], Column] | None = None,
    normalise: bool = False,
) -> DataFrame:
    """Add an embedding column; ``normalise`` scales vectors to unit length."""
    vec = (embedder or hashed_embedder())(F.col(text_col))
    out = df.withColumn(vector_col, vec)
    if normalise:
        out = out.withColumn(vector_col, vectors.l2_normalise(F.col(vector_col)))
    return out


def with_stored_vectors(
    chunks: DataFrame, stored: DataFrame, key: str = "chunk_id"
) -> DataFrame:
    """Attach vectors that were computed earlier instead of embedding again."""
    return chunks.join(stored, key, "inner")
