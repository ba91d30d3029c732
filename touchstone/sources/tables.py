"""Readers with declared schemas, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.sources import store

BRONZE_SCHEMAS = {
    "bronze_customers": (
        "customer_id BIGINT, first_name STRING, last_name STRING, email STRING, date_of_birth DATE, "
        "city STRING, kyc_status STRING, risk_rating INT, created_at DATE"
    ),
    "bronze_accounts": (
        "account_id BIGINT, customer_id BIGINT, account_type STRING, balance DOUBLE, currency STRING, "
        "opened_date DATE, status STRING"
    ),
    "bronze_transactions": (
        "txn_id BIGINT, account_id BIGINT, amount DOUBLE, currency STRING, txn_ts TIMESTAMP_NTZ, "
        "channel STRING, merchant_category_code INT"
    ),
}


def read_bronze(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A landed table, with its declared types rather than inferred ones."""
    if name not in BRONZE_SCHEMAS:
        raise KeyError(f"{name} is not a declared source; declared: {sorted(BRONZE_SCHEMAS)}")
    return spark.read.schema(BRONZE_SCHEMAS[name]).parquet(f"{folder}/{name}")


def versions(spark: SparkSession, folder: str, name: str) -> list[str]:
    """Where the rows of a table are, by build, oldest first; a version that several builds name comes once."""
    kept = [build.tables[name].parts for build in store.builds(spark, folder) if name in build.tables]
    return list(dict.fromkeys(f"{folder}/{parts[-1]}" for parts in kept))


def read_current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as the newest build has it."""
    build = store.latest(spark, folder)
    if build is None or name not in build.tables:
        raise FileNotFoundError(f"no build of {folder} has a table {name}")
    return store.read(spark, folder, build.tables[name])


def write_full_refresh(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Replace a table by a build of its own and return it as read from the new files."""
    with store.Builder(df.sparkSession, folder) as builder:
        written = builder.write(name, df)
        builder.publish()
    return written


def append_rows(df: DataFrame, folder: str, name: str) -> None:
    """Add rows to a table, or write its first ones."""
    with store.Builder(df.sparkSession, folder) as builder:
        builder.append(name, df)
        builder.publish()


def write_json(df: DataFrame, folder: str, name: str) -> None:
    """One JSON document per row, keeping missing fields visible as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def document(rows: DataFrame, order: Sequence[str], line: str, head: Sequence[str], empty: str) -> DataFrame:
    """A text as position and line: the head, then a line per row in order, or a message if there is none.

    Rows are sorted by ranges, and positions rise along the ranges, with gaps: no task sees all of them.
    """
    spark = rows.sparkSession
    top = spark.createDataFrame([(i - len(head), text) for i, text in enumerate(head)], "position BIGINT, line STRING")
    place = F.monotonically_increasing_id() + F.lit(1)
    body = rows.orderBy(*order).select(place.alias("position"), F.col(line).alias("line"))
    none = rows.agg(F.count("*").alias("_n")).filter("_n = 0").select(F.lit(1).cast("bigint"), F.lit(empty))
    return top.union(body).union(none)


def write_report(lines: DataFrame, folder: str, name: str) -> None:
    """A text deliverable: one string column, or `line` in the order of `position`. One file, since a reader
    reads it from top to bottom. The name may not lead out of the folder.
    """
    # The kinds of file a report may be.
    kinds = (".md", ".yml", ".yaml", ".json", ".sql")
    base = name.replace("\\", "/").rsplit("/", 1)[-1]
    if not base.endswith(kinds):
        raise ValueError(f"a report must end in one of {', '.join(kinds)}")
    if "position" in lines.columns:
        lines = lines.repartition(1).sortWithinPartitions("position").select("line")
    lines.write.mode("overwrite").text(f"{folder}/{base}")
