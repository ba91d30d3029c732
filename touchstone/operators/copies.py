"""Identical rows: counting them, numbering them, and keys without repeats.

Counting combines copies before the shuffle, so a row that makes up a third of the table costs
one partial count per task. A window over all columns would bring every copy to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COPIES = "_copies"
COPY_NUMBER = "copy_number"
BLOCK = 100_000


def tally(df: DataFrame) -> DataFrame:
    """Distinct rows, each with how often it occurs. Missing values count as equal."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def number_copies(tallied: DataFrame, first: int = 1) -> DataFrame:
    """One row per copy, from copy `first` on, with its number.

    A count is cut into blocks that are spread over tasks before they are unfolded, so no
    task has to write all copies of a frequent row.
    """
    spread = [c for c in tallied.columns if c != COPIES]
    extra = F.col(COPIES) - F.lit(first)
    blocks = (
        tallied.filter(extra >= 0)
        .withColumn("_block", F.explode(F.sequence(F.lit(0), F.floor(extra / F.lit(BLOCK)))))
        .repartition(*spread, "_block")
    )
    start = F.col("_block") * F.lit(BLOCK) + F.lit(first)
    stop = F.least(F.col(COPIES), start + F.lit(BLOCK - 1))
    return blocks.withColumn(COPY_NUMBER, F.explode(F.sequence(start, stop))).drop("_block", COPIES)


def keys(df: DataFrame, *names: str) -> DataFrame:
    """The distinct values of a key, for the right side of a semi or anti join."""
    return df.select(*names).distinct()


def first_per_key(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of every key in a given order.

    Spark cuts a row-number filter to one row per key in each task before it shuffles.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def with_group_size(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The rows that share their values with another row, with the size of their group.

    Groups are counted, and only those with several rows are joined back; a window would sort
    every group within one task. Missing values count as equal.
    """
    groups = df.groupBy(*[F.col(c).alias(f"_{c}") for c in columns]).agg(F.count(F.lit(1)).alias(name))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    return df.join(groups.filter(F.col(name) > 1), same).drop(*[f"_{c}" for c in columns])
