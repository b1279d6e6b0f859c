"""Vector expressions over array columns, computed in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 1e-8


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays of one length."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where the lengths differ or a norm is zero, null where a vector is."""
    scale = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when(F.size(a) != F.size(b), 0.0).when(scale == 0, 0.0).otherwise(dot(a, b) / F.when(scale == 0, 1.0).otherwise(scale))


def kept(value: Column, good: callable) -> Column:
    """Generator of `value` where it is good: evaluates it once, as no filter on it can be pushed below."""
    return F.explode(F.filter(F.array(value), good))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))
