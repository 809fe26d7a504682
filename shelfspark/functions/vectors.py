"""Vectors: dot products and the default offline embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from shelfspark.functions.text import words

DIMENSIONS = 64


def cosine_similarity(left: Column, right: Column) -> Column:
    """Dot product of two normalised vectors; lengths that differ are an error."""
    product = F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0), lambda total, x: total + x)
    return F.when(F.size(left) != F.size(right),
                  F.raise_error(F.lit("vectors differ in length")).cast("double")).otherwise(product)


def bucket_of(token: str, dimensions: int = DIMENSIONS) -> int:
    """Position a token counts towards."""
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dimensions


class Buckets(dict):
    """Positions of the tokens met so far."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions

    def __missing__(self, token: str) -> int:
        at = self[token] = bucket_of(token, self.dimensions)
        return at

    def trim(self) -> None:
        if len(self) > 200_000:
            self.clear()


def hashed_embedder(dimensions: int = DIMENSIONS, prefix: str = ""):
    """Arrow function text -> unit vector of hashed token counts.

    The pluggable default: any function of the same shape may replace it. ``prefix`` is
    the instruction put before a query text.
    """
    @F.pandas_udf(ArrayType(FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo = Buckets(dimensions)
        for batch in batches:
            out = []
            for text in batch:
                memo.trim()
                at = np.fromiter(map(memo.__getitem__, words(prefix + (text or ""))), np.int64)
                vector = np.bincount(at, minlength=dimensions).astype("float64")
                norm = np.sqrt((vector * vector).sum())
                out.append((vector / norm if norm else vector).astype("float32"))
            yield pd.Series(out)

    return embed
