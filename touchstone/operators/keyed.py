"""Joins and set operations on keys, in the forms the models use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchstone.operators.copies import keys


def without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows whose key is not on the right; a missing key is on no right side."""
    return left.join(keys(right, key), key, "left_anti").select(*left.columns)


def within(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(keys(right, key), key, "left_semi").select(*left.columns)


def without_by_outer_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The same rows as `without`, the way SQL without an anti join writes it."""
    known = keys(right, key).select(F.col(key).alias("_known"), F.lit(True).alias("_hit"))
    joined = left.join(known, F.col(key) == F.col("_known"), "left")
    return joined.filter(F.col("_hit").isNull()).select(*left.columns)


def ids_only_in(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Key values of the left that the right does not have. Repeats go before the comparison."""
    return keys(left, key).subtract(keys(right, key))


def ids_in_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return keys(left, key).intersect(keys(right, key))


def bounded(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first rows in a given order and whether there were more.

    One row beyond the limit is fetched to tell; only limit + 1 rows reach the last step.
    """
    top = df.orderBy(*order).limit(limit + 1)
    everything = Window.partitionBy()
    return (
        top.withColumns(
            {
                "_position": F.row_number().over(Window.partitionBy().orderBy(*order)),
                "truncated": F.count(F.lit(1)).over(everything) > limit,
            }
        )
        .filter(F.col("_position") <= limit)
        .drop("_position")
    )
