"""Bronze tables projected from the customer, orders and lineitem test tables.

The source tables are clean, so each projection also puts in the defects the models must
handle. The expressions are SQL that Spark and DuckDB read alike; the oracle reuses the text.
Repeated rows come from one scan with an exploded copy count, not from a union of scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.session import small_tasks

SOURCES = {
    "bronze_customers": (
        "customer",
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    ),
    "bronze_accounts": (
        "orders",
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    ),
    "bronze_transactions": (
        "lineitem",
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
        "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    ),
}

K = "(c_custkey + 1)"  # customer 0 is kept free for the unknown member

EXPRESSIONS = {
    "bronze_customers": {
        "customer_id": K,
        "first_name": f"CASE WHEN {K} % 6 = 0 THEN '  ' || lower(c_mktsegment) ELSE c_mktsegment END",
        "last_name": "replace(c_name, '#', ' ')",
        "email": (
            f"CASE WHEN {K} % 12 = 0 THEN NULL "
            f"WHEN {K} % 19 = 0 THEN 'C' || CAST({K} AS STRING) || '(at)example.com' "
            f"WHEN {K} % 50 = 7 THEN 'Shared' || CAST({K} % 100 AS STRING) || '@Example.com' "
            f"ELSE 'C' || CAST({K} AS STRING) || '@Example.com' END"
        ),
        "date_of_birth": (
            f"CASE WHEN {K} % 20 = 0 THEN NULL "
            f"WHEN {K} % 31 = 0 THEN DATE '2020-01-01' + CAST(({K} * 37) % 1461 AS INT) "
            f"WHEN {K} % 67 = 5 THEN DATE '1900-05-05' "
            f"ELSE DATE '1945-01-01' + CAST(({K} * 7919) % 21915 AS INT) END"
        ),
        "city": (
            f"CASE {K} % 9 WHEN 0 THEN 'London' WHEN 1 THEN 'Manchester' WHEN 2 THEN 'Leeds' "
            "WHEN 3 THEN 'Bristol' WHEN 4 THEN 'Birmingham' WHEN 5 THEN 'Glasgow' "
            "WHEN 6 THEN '  London ' WHEN 7 THEN 'LONDON' END"
        ),
        "kyc_status": (
            f"CASE {K} % 7 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'verified' WHEN 2 THEN 'PENDING' "
            "WHEN 3 THEN 'pending' WHEN 4 THEN 'REJECTED' WHEN 5 THEN '' END"
        ),
        "risk_rating": (
            f"CAST(CASE {K} % 11 WHEN 0 THEN 99 WHEN 1 THEN NULL WHEN 2 THEN 99 ELSE {K} % 5 + 1 END AS INT)"
        ),
        "created_at": (
            f"CASE WHEN {K} % 53 = 7 AND {K} % 20 <> 0 THEN NULL "
            f"ELSE DATE '2019-01-01' + CAST(({K} * 104729) % 2191 AS INT) END"
        ),
    },
    "bronze_accounts": {
        "account_id": "o_orderkey + 1",
        "customer_id": "CASE WHEN o_orderkey % 250 = 3 THEN 900000000 + o_orderkey ELSE o_custkey + 1 END",
        "account_type": (
            "CASE o_orderkey % 9 WHEN 0 THEN 'CURRENT' WHEN 1 THEN 'current' WHEN 2 THEN ' Current ' "
            "WHEN 3 THEN 'SAVINGS' WHEN 4 THEN 'savings' WHEN 5 THEN 'SAV' WHEN 6 THEN 'CUR' "
            "WHEN 7 THEN 'ISA' END"
        ),
        "balance": (
            "CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 100 "
            "WHEN o_orderkey % 9 = 4 THEN -o_totalprice ELSE o_totalprice END"
        ),
        "currency": "'GBP'",
        "opened_date": "CAST(o_orderdate AS DATE)",
        "status": (
            "CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN NULL "
            "WHEN o_orderstatus = 'O' THEN ' open' WHEN o_orderstatus = 'F' THEN 'CLOSED' "
            "ELSE 'DORMANT' END"
        ),
    },
    "bronze_transactions": {
        "txn_id": "l_orderkey * 8 + l_linenumber",
        "account_id": "CASE WHEN l_partkey % 97 = 0 THEN 900000000 + l_orderkey ELSE l_orderkey + 1 END",
        "amount": "CASE WHEN l_linenumber % 2 = 0 THEN -l_extendedprice ELSE l_extendedprice END",
        "currency": "CASE l_suppkey % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN 'usd' ELSE 'GBP' END",
        "txn_ts": "CASE WHEN l_partkey % 50 = 0 THEN l_shipdate + INTERVAL 4000 DAY ELSE l_shipdate END",
        "channel": (
            "CASE l_suppkey % 10 WHEN 0 THEN 'ATM' WHEN 1 THEN 'atm' WHEN 2 THEN 'POS' WHEN 3 THEN 'pos' "
            "WHEN 4 THEN 'ONLINE' WHEN 5 THEN 'Online' WHEN 6 THEN 'BRANCH' WHEN 7 THEN 'branch' "
            "WHEN 8 THEN '' END"
        ),
        "merchant_category_code": (
            "CAST(CASE l_partkey % 6 WHEN 0 THEN 5411 WHEN 1 THEN 5812 WHEN 2 THEN 6011 "
            "WHEN 3 THEN 4829 WHEN 4 THEN 5999 END AS INT)"
        ),
    },
}

# Conditions on a projected row, each of which lands one more copy of it.
REPEATS = {
    "bronze_customers": ["customer_id % 33 = 0", "customer_id % 66 = 0"],
    "bronze_accounts": [],
    "bronze_transactions": ["account_id % 200 = 0"],
}


def source_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table, schema = SOURCES[name]
    small_tasks(spark)
    return spark.read.schema(schema).parquet(f"{folder}/{table}.parquet")


def select_items(expressions: dict[str, str]) -> list[str]:
    return [f"{expression} AS {column}" for column, expression in expressions.items()]


def select_list(expressions: dict[str, str]) -> str:
    return ", ".join(select_items(expressions))


def derive(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = source_table(spark, folder, name).selectExpr(*select_items(EXPRESSIONS[name]))
    repeats = REPEATS[name]
    if not repeats:
        return rows
    copies = " + ".join(f"coalesce(CAST({condition} AS INT), 0)" for condition in repeats)
    choices = ", ".join(f"array({', '.join(map(str, range(n + 1)))})" for n in range(len(repeats) + 1))
    return rows.withColumn("_copy", F.expr(f"explode(element_at(array({choices}), 1 + {copies}))")).drop("_copy")


def derive_sql(name: str) -> str:
    """The same table as SQL text, for the oracle."""
    select = f"SELECT {select_list(EXPRESSIONS[name])} FROM {SOURCES[name][0]}"
    parts = [select] + [f"SELECT * FROM ({select}) AS rows WHERE {condition}" for condition in REPEATS[name]]
    return " UNION ALL ".join(parts)
