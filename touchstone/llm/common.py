"""What several corpus operators share: reading, batch sizes, and sums and ranks along an order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from touchstone.session import materialise

__all__ = ["WORD", "byte_slices", "documents", "mapped", "materialise", "position_key", "running_total", "small_batches"]

#: A word: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one group of a running total holds on average.
GROUP_ROWS = 1024

#: Arrow batches stay under this, so that a task with very long documents stays in memory. The JVM, Arrow and Python each
#: hold a batch at once, on both ways, and what they took for it stays with the executor.
BATCH_BYTES = 4 * 1024**2


def documents(spark: SparkSession, folder: str) -> DataFrame:
    schema = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
    return spark.read.schema(schema).parquet(f"{folder}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes and not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def mapped(rows: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """`mapInPandas` for rows with a doc_id that may be null, which the function has as text.

    pandas has whole numbers next to a null as doubles, which are exact up to 2^53 only.
    """
    named = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = named.mapInPandas(run, schema.replace("doc_id BIGINT", "doc_id STRING"))
    return out.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def position_key(column: Column) -> Column:
    """A text that sorts by code point with null last, and that equality joins can use."""
    return F.when(column.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), column))


def running_total(rows: DataFrame, key: str, place: Column, order: list, value: Column, n_rows: int) -> DataFrame:
    """Adds `bucket`, `seq` (identity within the bucket) and `before`: the sum of `value` over the rows
    that come earlier in the order within the same key.

    `place` is a rough position in [0, 2^32) that agrees with `order`. Rows are summed in groups of
    about GROUP_ROWS by place, and only one row for each group is summed along the whole key, so a
    key with a third of all rows is spread over many tasks.
    """
    buckets = max(1, -(-n_rows // GROUP_ROWS))
    rows = rows.withColumn("bucket", F.shiftright(place.cast("bigint") * F.lit(buckets).cast("bigint"), 32))
    within = Window.partitionBy(key, "bucket").orderBy(*order)
    summed = rows.groupBy(key, "bucket").agg(F.sum(value).alias("bucket_sum"))
    along = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = summed.select(key, "bucket", F.coalesce(F.sum("bucket_sum").over(along), F.lit(0)).alias("bucket_start"))
    numbered = rows.withColumn("seq", F.row_number().over(within)).withColumn(
        "before", F.coalesce(F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    joined = numbered.join(starts, [key, "bucket"])
    return joined.withColumn("before", (F.col("before") + F.col("bucket_start")).cast("bigint")).drop("bucket_start")


def byte_slices(batches: Iterator[pd.DataFrame], limit: int = 1 << 20) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Rows with the UTF-8 bytes of their `text` (null: empty), about `limit` bytes at a time."""
    for batch in batches:
        raw = [t.encode() if isinstance(t, str) else b"" for t in batch["text"]]
        if not raw:
            continue
        part = np.cumsum([len(r) for r in raw]) // limit
        for n in np.unique(part):
            rows = np.flatnonzero(part == n)
            yield batch.iloc[rows], [raw[i] for i in rows]
