"""Dense vector arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column, clip: bool = False) -> Column:
    """Cosine similarity; 0 for a zero vector or unequal lengths; [0, 1] when clipped."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    raw = F.when((F.size(a) != F.size(b)) | (norms == 0), F.lit(0.0)).otherwise(F.try_divide(dot(a, b), norms))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) if clip else raw


def fit_length(vector: Column, dim: int) -> Column:
    """Exactly ``dim`` numbers: zeros appended or the tail cut."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    return F.slice(F.concat(vector.cast("array<double>"), zeros), 1, dim)
