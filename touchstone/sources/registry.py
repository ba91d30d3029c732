"""A registry of many contracts and their proposed revisions, projected from orders and lineitem.

An order is a contract and its lines are the columns and rules. The revisions contain every
kind of change. The expressions are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.sources.derived import select_items, select_list, source_table

# The test table repeats some lines of an order.
LINES = {"o": "l_orderkey", "n": "l_linenumber", "p": "min(l_partkey)", "s": "min(l_suppkey)"}

ID = "'ds_' || CAST(o AS STRING)"
N = "CAST(n AS STRING)"
TYPE = "CASE p % 4 WHEN 0 THEN 'BIGINT' WHEN 1 THEN 'VARCHAR' WHEN 2 THEN 'DATE' ELSE 'DOUBLE' END"
NULLABLE = "CASE WHEN s % 7 = 0 THEN NULL ELSE s % 3 <> 0 END"
ASSERTION = (
    f"CASE p % 3 WHEN 0 THEN 'SELECT count(*) FROM ds_' || CAST(o AS STRING) || ' WHERE c' || {N} || ' IS NOT NULL "
    f"AND c' || {N} || ' NOT IN (''A'', ''B'')' "
    f"WHEN 1 THEN 'SELECT count(*) FROM ds_' || CAST(o AS STRING) || ' WHERE c' || {N} || ' IS NULL' "
    f"ELSE 'select count(*) from ds_' || CAST(o AS STRING) || ' where \"c' || {N} || '\" is not null "
    f"and \"c' || {N} || '\" not in (''X'',''Y'',''Z'')' END"
)

OLD_COLUMNS = {
    "contract_id": ID,
    "name": f"'c' || {N}",
    "type": TYPE,
    "nullable": NULLABLE,
    "pii": "p % 5 = 0",
    "description": "'text ' || CAST(p % 3 AS STRING)",
}
# Each of these is a list of (expressions, condition on the line).
NEW_COLUMNS = [
    (
        OLD_COLUMNS
        | {
            "type": f"CASE WHEN p % 13 = 0 THEN 'DECIMAL' ELSE {TYPE} END",
            "nullable": f"CASE WHEN p % 17 = 0 THEN NOT coalesce({NULLABLE}, true) ELSE {NULLABLE} END",
            "pii": "CASE WHEN p % 19 = 0 THEN p % 5 <> 0 ELSE p % 5 = 0 END",
            "description": "CASE WHEN p % 23 = 0 THEN 'reworded' ELSE 'text ' || CAST(p % 3 AS STRING) END",
        },
        "p % 11 <> 0",
    ),
    (
        {
            "contract_id": ID,
            "name": f"'n' || {N}",
            "type": "'VARCHAR'",
            "nullable": "CASE s % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END",
            "pii": "false",
            "description": "'new'",
        },
        "p % 29 = 0",
    ),
]
OLD_RULES = {
    "contract_id": ID,
    "name": f"'r' || {N}",
    "severity": "CASE s % 2 WHEN 0 THEN 'blocking' ELSE 'warning' END",
    "assertion": ASSERTION,
}
NEW_RULES = [
    (
        OLD_RULES
        | {
            "severity": "CASE WHEN p % 37 = 0 THEN 'review' ELSE CASE s % 2 WHEN 0 THEN 'blocking' ELSE 'warning' END END",
            "assertion": f"CASE WHEN p % 21 = 0 THEN replace({ASSERTION}, 'B', 'C') ELSE {ASSERTION} END",
        },
        "s % 11 <> 0",
    ),
    (OLD_RULES | {"name": f"'q' || {N}"}, "s % 13 = 0"),
]
OLD_HEADERS = {
    "contract_id": "'ds_' || CAST(o_orderkey AS STRING)",
    "version": (
        "CAST(o_custkey % 3 + 1 AS STRING) || '.' || CAST(o_orderkey % 5 AS STRING) || '.' || "
        "CAST(o_orderkey % 7 AS STRING)"
    ),
    "domain": "'domain ' || o_orderpriority",
    "owner": "'team' || CAST(o_custkey % 20 AS STRING) || '@example.com'",
    "description": "'orders of ' || CAST(o_custkey AS STRING)",
    "freshness": "CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'hourly' ELSE 'daily' END",
}
NEW_HEADERS = OLD_HEADERS | {
    "owner": f"CASE WHEN o_custkey % 9 = 0 THEN 'office@example.com' ELSE {OLD_HEADERS['owner']} END",
    "freshness": f"CASE WHEN o_orderkey % 6 = 0 THEN 'weekly' ELSE {OLD_HEADERS['freshness']} END",
}


class Registry:
    """The contract tables of both sides."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        lines = source_table(spark, folder, "bronze_transactions")
        self._lines = lines.groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s")
        ).withColumnsRenamed({"l_orderkey": "o", "l_linenumber": "n"})
        self._orders = source_table(spark, folder, "bronze_accounts")

    def _parts(self, parts: list) -> DataFrame:
        first, second = (self._lines.filter(condition).selectExpr(*select_items(e)) for e, condition in parts)
        return first.unionByName(second)

    @property
    def old_columns(self) -> DataFrame:
        return self._lines.selectExpr(*select_items(OLD_COLUMNS))

    @property
    def new_columns(self) -> DataFrame:
        return self._parts(NEW_COLUMNS)

    @property
    def old_rules(self) -> DataFrame:
        return self._lines.selectExpr(*select_items(OLD_RULES))

    @property
    def new_rules(self) -> DataFrame:
        return self._parts(NEW_RULES)

    @property
    def old_headers(self) -> DataFrame:
        headers = self._orders.selectExpr(*select_items(OLD_HEADERS))
        return headers.selectExpr("*", "array(named_struct('version', version, 'note', 'Baseline.')) AS change_log")

    @property
    def new_headers(self) -> DataFrame:
        return self._orders.selectExpr(*select_items(NEW_HEADERS))


def registry_sql() -> dict[str, str]:
    """The same tables as SQL text, for the oracle."""

    def parts(sides: list) -> str:
        return " UNION ALL ".join(
            f"SELECT {select_list(e)} FROM contract_lines WHERE {condition}" for e, condition in sides
        )

    return {
        "contract_lines": f"SELECT {select_list(LINES)} FROM lineitem GROUP BY l_orderkey, l_linenumber",
        "old_columns": f"SELECT {select_list(OLD_COLUMNS)} FROM contract_lines",
        "new_columns": parts(NEW_COLUMNS),
        "old_rules": f"SELECT {select_list(OLD_RULES)} FROM contract_lines",
        "new_rules": parts(NEW_RULES),
        "old_headers": f"SELECT {select_list(OLD_HEADERS)} FROM orders",
        "new_headers": f"SELECT {select_list(NEW_HEADERS)} FROM orders",
    }
