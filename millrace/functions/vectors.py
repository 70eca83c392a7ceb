"""Vector and group arithmetic on array columns (FN13, FN14, SIM1-SIM3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, in doubles, in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def square_sum(a: Column) -> Column:
    return dot(a, a)


def mean_of(a: Column) -> Column:
    return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length (SIM2)."""
    return F.try_divide(dot(a, b), F.sqrt(square_sum(a)) * F.sqrt(square_sum(b)))


def continuous_tanimoto(a: Column, b: Column) -> Column:
    """a.b / (a.a + b.b - a.b) (SIM3)."""
    ab = dot(a, b)
    return F.try_divide(ab, square_sum(a) + square_sum(b) - ab)


def share_of_group(rows: DataFrame, group: str, value: Column, by: Column, name: str) -> DataFrame:
    """rows with value times the sum of by over the group, over the square of the group's size (FN14)."""
    w = Window.partitionBy(group)
    return rows.withColumn(name, F.try_divide(value * F.sum(by).over(w), F.pow(F.count("*").over(w), 2)))
