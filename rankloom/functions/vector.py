"""Dense vectors: cosine against a fixed query, JVM-side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_dims(query: Sequence[float], dims: int) -> int:
    """dims, or the query's length where dims is 0; an error if they differ."""
    if dims and len(query) != dims:
        raise ValueError(f"query vector has {len(query)} dimensions, {dims} expected")
    return dims or len(query)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """0 where either side has no length. vector: an array of doubles as long as the query."""
    length = math.sqrt(sum(float(x) * float(x) for x in query))
    if length == 0:
        return F.when(vector.isNotNull(), F.lit(0.0))
    held = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, held, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    norm = l2_norm(vector)
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / (norm * F.lit(length)))
