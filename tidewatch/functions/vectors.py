"""Vectors as arrays of floats."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, functions as F, types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), norm(a)))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashed_embedding(texts: pd.Series) -> pd.Series:
    """Signed hashing of character 3-5-grams within words into 384 buckets, scaled to length 1."""

    def one(text: str | None) -> list[float]:
        out = np.zeros(384, np.float32)
        for word in (text or "").lower().split():
            padded = f" {word} "
            for n in (3, 4, 5):
                for i in range(max(1, len(padded) - n + 1)):
                    h = xxhash.xxh32_intdigest(padded[i : i + n])
                    out[h % 384] += 1.0 if h & 0x80000000 else -1.0
        size = np.linalg.norm(out)
        return (out / size if size else out).tolist()

    return texts.map(one)
