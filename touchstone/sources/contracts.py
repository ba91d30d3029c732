"""Data contracts: one file as a record to plan with, a folder of files as tables."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT_SCHEMA = (
    "metadata STRUCT<name: STRING, version: STRING, domain: STRING, owner: STRING, "
    "change_log: ARRAY<STRUCT<version: STRING, note: STRING>>>, "
    "description STRING, semantics STRUCT<freshness: STRING>, "
    "schema ARRAY<STRUCT<name: STRING, type: STRING, nullable: BOOLEAN, pii: BOOLEAN, description: STRING>>, "
    "quality_rules ARRAY<STRUCT<name: STRING, severity: STRING, assertion: STRING>>, "
    "profile_expectations STRUCT<row_count_min: BIGINT, null_rate_tolerance: DOUBLE, "
    "columns: MAP<STRING, STRUCT<null_rate: DOUBLE>>>"
)
# The approved contract of silver_customers, its columns, rules and expectations.
SHIPPED = Path(__file__).parent.parent / "contracts"


def load_contract(table: str, folder: str | Path = SHIPPED) -> dict[str, Any]:
    """The approved contract of one table, from a JSON file or, where PyYAML is there, a YAML one."""
    base = Path(folder)
    for path in (base / f"{table}.json", base / f"{table}.yml", base / f"{table}.yaml"):
        if path.exists():
            return _checked(_parsed(path), path.name)
    raise FileNotFoundError(f"no approved contract for {table} in {folder}")


def _parsed(path: Path) -> dict[str, Any]:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError(f"{path.name} needs PyYAML; JSON contracts do not") from error
    return yaml.safe_load(text)


def _checked(contract: dict[str, Any], source: str) -> dict[str, Any]:
    for part in ("schema", "quality_rules"):
        for position, item in enumerate(contract.get(part) or [], start=1):
            if "name" not in item:
                raise ValueError(f"{source}: entry {position} of {part} has no name")
    return contract


def personal_names(contract: dict[str, Any]) -> list[str]:
    """The columns that a contract calls personal."""
    return [column["name"] for column in contract["schema"] if column.get("pii")]


def read_contracts(spark: SparkSession, folder: str, by_line: bool = False) -> DataFrame:
    """All JSON contracts of a folder, one row each: one in each file, or one in each line."""
    return spark.read.schema(CONTRACT_SCHEMA).option("multiLine", str(not by_line).lower()).json(folder)


def contract_documents(headers: DataFrame, columns: DataFrame, rules: DataFrame) -> DataFrame:
    """Contract tables as documents of CONTRACT_SCHEMA, as far as the tables go. A contract has few columns and rules."""
    named = columns.groupBy("contract_id").agg(
        F.array_sort(F.collect_list(F.struct("name", "type", "nullable", "pii", "description"))).alias("schema")
    )
    ruled = rules.groupBy("contract_id").agg(F.array_sort(F.collect_list(F.struct("name", "severity", "assertion"))).alias("quality_rules"))
    whole = headers.join(named, "contract_id", "left").join(ruled, "contract_id", "left")
    about = F.struct(F.col("contract_id").alias("name"), "version", "domain", "owner", "change_log")
    return whole.select(about.alias("metadata"), "description", F.struct("freshness").alias("semantics"), "schema", "quality_rules")


def contract_columns(contracts: DataFrame) -> DataFrame:
    return contracts.select(
        F.col("metadata.name").alias("contract_id"), F.posexplode("schema").alias("position", "column")
    ).select("contract_id", (F.col("position") + 1).alias("ordinal"), "column.*")


def contract_rules(contracts: DataFrame) -> DataFrame:
    return contracts.select(F.col("metadata.name").alias("contract_id"), F.inline("quality_rules"))


def contract_expectations(contracts: DataFrame) -> DataFrame:
    return contracts.select(
        F.col("metadata.name").alias("contract_id"),
        F.col("profile_expectations.null_rate_tolerance").alias("tolerance"),
        F.explode("profile_expectations.columns").alias("column_name", "expected"),
    ).select("contract_id", "column_name", F.col("expected.null_rate").alias("null_rate"), "tolerance")


def contract_headers(contracts: DataFrame) -> DataFrame:
    return contracts.select(
        F.col("metadata.name").alias("contract_id"),
        "metadata.version",
        "metadata.domain",
        "metadata.owner",
        "description",
        "semantics.freshness",
        "metadata.change_log",
    )
