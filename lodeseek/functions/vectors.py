"""Vector scores as columns, and hashed text vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .analyzers import tokens


Query = list[float] | Column


def _query(values: Query) -> Column:
    return _doubles(values) if isinstance(values, Column) else F.array(*[F.lit(float(v)) for v in values])


def _doubles(col: Column) -> Column:
    return col.cast("array<double>")


def dot(col: Column, query: Query) -> Column:
    return F.aggregate(F.zip_with(_doubles(col), _query(query), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def cosine(col: Column, query: Query) -> Column:
    """In [-1, 1]; 0 with a zero vector."""
    size = lambda c: F.sqrt(F.aggregate(_doubles(c), F.lit(0.0), lambda s, x: s + x * x))
    own = size(col)
    if isinstance(query, Column):
        both = own * size(query)
        return F.when(both == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(col, query) / both)))
    length = float(np.sqrt(np.square(np.asarray(query, dtype=float)).sum()))
    if not length:
        return F.when(col.isNotNull(), 0.0)
    return F.when(own == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(col, query) / (own * F.lit(length)))))


def euclidean(col: Column, query: Query) -> Column:
    """1 / (1 + distance)."""
    squares = F.aggregate(F.zip_with(_doubles(col), _query(query), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) / (F.lit(1.0) + F.sqrt(squares))


METRICS = {"cosine": cosine, "dotProduct": dot, "euclidean": euclidean}


def _fnv(token: str) -> int:
    h = 0xCBF29CE484222325
    for b in token.encode():
        h = ((h ^ b) * 0x100000001B3) & (1 << 64) - 1
    return h


def text_vector(text: str, dimensions: int) -> list[float] | None:
    """English tokens added to the bucket of their FNV-1a hash, negative where its top bit is set, to unit length; None for a zero vector."""
    out = np.zeros(dimensions)
    for t in tokens(text, None):
        h = _fnv(t)
        out[h % dimensions] += -1.0 if h >> 63 else 1.0
    length = np.sqrt((out * out).sum())
    return (out / length).astype(np.float32).tolist() if length else None


def embed(col: Column, dimensions: int) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text_vector(t, dimensions) if t else None)

    return F.pandas_udf(of, "array<float>")(col)
