"""Vector arithmetic as column expressions."""

from pyspark.sql import Column, functions as F


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; zero for unequal lengths or a zero vector."""
    scale = norm(a) * norm(b)
    comparable = (F.size(a) == F.size(b)) & (scale > 0)
    return F.when(comparable, F.try_divide(dot(a, b), scale)).otherwise(F.lit(0.0))
