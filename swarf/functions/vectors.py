"""Expressions on short ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(col) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: x.cast("double"))


def total(col) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def element_means(vectors: Column, dim: int) -> Column:
    """Position-wise mean of an array of equally long vectors."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: total(F.transform(vectors, lambda v: v[i])) / F.size(vectors),
    )


def pad_left(values: Column, size: int) -> Column:
    return F.concat(F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(size) - F.size(values))), values)


def pad_right(values: Column, size: Column, fill: Column) -> Column:
    return F.concat(values, F.array_repeat(fill, F.greatest(F.lit(0), size - F.size(values)).cast("int")))
