"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def length(vector: Column) -> Column:
    return F.sqrt(inner_product(vector, vector))


def normalised(vector: Column) -> Column:
    """The vector at length one, so that an inner product is a cosine; a zero vector stays."""
    norm = length(vector)
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(
        F.transform(vector, lambda x: x.cast("double"))
    )
