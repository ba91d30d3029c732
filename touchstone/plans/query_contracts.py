"""Queries: contract tables, drift of a live table, contract diffs and versions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.functions.text import verdict
from touchstone.operators import contract_diff, drift
from touchstone.plans import medallion
from touchstone.plans.lakehouse import TABLES, Lakehouse
from touchstone.plans.oracles import CTES
from touchstone.plans.registry import over_folder, over_tables
from touchstone.session import drop_at_exit, isolated, scratch_path
from touchstone.sources.contracts import contract_columns, contract_documents, load_contract, read_contracts
from touchstone.sources.registry import Registry
from touchstone.sources.tables import read_current, write_json, write_report

CONTRACT = load_contract("silver_customers")


def evolved_checks(lake: Lakehouse, kinds: list[str]) -> DataFrame:
    """The checks of the approved contract on the evolved customers.

    Rules in SQL see the tables as views of a session of their own, and only those they name.
    """
    inner = lake.in_session(isolated(lake.spark))
    evolved = medallion.evolve_customers(inner["silver_customers"])
    inner.replace("silver_customers", evolved)

    def evaluate(sql: str) -> DataFrame:
        for name in TABLES:
            if re.search(rf"\b{name}\b", sql, re.I):
                inner[name].createOrReplaceTempView(name)
        return inner.spark.sql(sql)

    return drift.checks(evolved, "silver_customers", CONTRACT, evaluate, kinds)


# ------------------------------------------------------------------ drift


def _check_sql(kind: str, subject: str, observed: str, expected: str, detail: str, severity: str, drifted: str) -> str:
    return (
        f"SELECT '{kind}' AS kind, '{subject}' AS subject, CAST({observed} AS DOUBLE) AS observed, "
        f"CAST({expected} AS DOUBLE) AS expected, {detail} AS detail, '{severity}' AS severity, {drifted} AS drifted "
        "FROM evolved_customers"
    )


def _added(column: str, kind: str) -> str:
    detail = f"'{column} {kind} is in the table but not in the contract'"
    return _check_sql("SCHEMA_ADDED", column, f"count({column})", "NULL", detail, "review", "true")


def _nulls(column: str) -> str:
    nulls = f"(count(*) - count({column}))"
    detail = f"'{column} must not be null, ' || {nulls} || ' rows are'"
    return _check_sql("NULLABILITY", column, nulls, "0", detail, "breaking", f"{nulls} > 0")


def _rate(column: str, expected: float) -> str:
    rate = f"avg(CASE WHEN {column} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    detail = f"printf('{column} is %.1f%% null, expected %.0f%% within 6%%', 100 * {rate}, {100 * expected:.1f}::DOUBLE)"
    return _check_sql("NULL_RATE", column, rate, str(expected), detail, "review", f"abs({rate} - {expected}) > 0.06")


def _rule(name: str, value: str) -> str:
    detail = f"'{name} returned ' || {value} || ', expected 0'"
    return _check_sql("RULE_FAILING", name, value, "0", detail, "blocking", f"{value} <> 0")


CONSERVED = (
    "max((SELECT abs(b - s - r) FROM (SELECT (SELECT count(*) FROM bronze_customers) AS b, "
    "(SELECT count(*) FROM evolved_customers WHERE customer_id > 0) AS s, "
    "(SELECT count(*) FROM silver_customers_rejected) AS r)))"
)
CHECK_SQL = {
    "drift_schema": [_added("marketing_consent", "BOOLEAN"), _added("customer_segment", "VARCHAR")],
    "drift_nullability": [_nulls(c) for c in ["customer_id", "first_name", "last_name", "created_at"]],
    "drift_null_rate": [
        _rate(c, e)
        for c, e in {
            "email": 0.10,
            "date_of_birth": 0.04,
            "city": 0.12,
            "kyc_status": 0.25,
            "risk_rating": 0.33,
        }.items()
    ],
    "drift_row_count": [
        _check_sql(
            "ROW_COUNT", "*", "count(*)", "250", "count(*) || ' rows, expected at least 250'", "breaking", "count(*) < 250"
        )
    ],
    "drift_rules": [
        _rule("pk_not_null_unique", "(count(*) - count(DISTINCT customer_id))"),
        _rule("names_present", "(2 * count(*) - count(first_name) - count(last_name))"),
        _rule("kyc_status_enum", "count(*) FILTER (WHERE NOT regexp_full_match(kyc_status, 'VERIFIED|PENDING|REJECTED'))"),
        _rule("risk_rating_range", "count(*) FILTER (WHERE risk_rating < 1 OR risk_rating > 5)"),
        _rule("adult_at_onboarding", "count(*) FILTER (WHERE CAST(created_at - INTERVAL 18 YEAR AS DATE) < date_of_birth)"),
        _rule("row_conservation", CONSERVED),
        _rule("unknown_member_present", "abs(1 - count(*) FILTER (WHERE customer_id = 0))"),
    ],
}
ENUM_SQL = [
    _check_sql(
        "ENUM_EXPANDED",
        "kyc_status",
        "count(*)",
        "0",
        "'kyc_status has a value outside the list: ' || kyc_status || ', in ' || count(*) || ' rows'",
        "review",
        "true",
    )
    + " WHERE NOT regexp_full_match(kyc_status, 'VERIFIED|PENDING|REJECTED') GROUP BY kyc_status"
]
KIND_OF = {
    "drift_schema": "SCHEMA",
    "drift_nullability": "NULLABILITY",
    "drift_null_rate": "NULL_RATE",
    "drift_row_count": "ROW_COUNT",
    "drift_rules": "RULE_FAILING",
}

for _key, _kind in KIND_OF.items():
    over_tables(_key, " UNION ALL ".join(CHECK_SQL[_key]))(lambda lake, k=_kind: evolved_checks(lake, [k]))

over_tables(
    "drift_enum",
    "SELECT kyc_status AS value, count(*) AS n_rows FROM evolved_customers "
    "WHERE kyc_status IS NOT NULL GROUP BY kyc_status HAVING NOT regexp_full_match(kyc_status, 'VERIFIED|PENDING|REJECTED')",
)(
    lambda lake: drift.unexpected_values(
        medallion.evolve_customers(lake["silver_customers"]),
        "kyc_status",
        drift.listed_values(lake.spark, CONTRACT["quality_rules"])["kyc_status"],
    )
)

CTES["drift_checks"] = " UNION ALL ".join([sql for part in CHECK_SQL.values() for sql in part] + ENUM_SQL)

over_tables("drift_report", "SELECT * EXCLUDE (drifted) FROM drift_checks WHERE drifted")(
    lambda lake: drift.report(evolved_checks(lake, drift.KINDS))
)
over_tables(
    "drift_gate",
    "SELECT count(*) FILTER (WHERE drifted) AS n_drifts, "
    "count(*) FILTER (WHERE drifted AND severity IN ('breaking', 'blocking')) AS n_serious, "
    "NOT coalesce(bool_or(drifted), false) AS passed FROM drift_checks",
)(lambda lake: drift.gate(evolved_checks(lake, drift.KINDS)))


# ------------------------------------------------------------------ contract tables


over_folder("contract_columns", "SELECT * FROM old_columns")(lambda spark, folder: Registry(spark, folder).old_columns)


@over_folder(
    "parse_enum_rules",
    "SELECT contract_id, name, column_name, trim(trim(unnest(string_split(list, ','))), '''\"') AS value FROM ("
    "SELECT *, regexp_extract(assertion, '(?i)where \"?(\\w+)', 1) AS column_name, "
    "regexp_extract(assertion, '(?i)not in \\((.*)\\)', 1) AS list FROM old_rules) WHERE list <> ''",
)
def _enum_rules(spark: SparkSession, folder: str) -> DataFrame:
    return drift.parse_enum_rules(Registry(spark, folder).old_rules).select(
        "contract_id", "name", "column_name", "value"
    )


COLUMN_CHANGES = (
    "SELECT contract_id, 'schema.' || name AS path, CASE WHEN o.type IS NULL THEN 'added' WHEN n.type IS NULL "
    "THEN 'removed' ELSE 'modified' END AS kind, CASE "
    "WHEN o.type IS NULL THEN if(ifnull(n.nullable, true), 'additive', 'breaking') WHEN n.type IS NULL THEN 'breaking' "
    "WHEN o.type <> n.type OR (o.nullable = true AND n.nullable = false) THEN 'breaking' "
    "WHEN o.nullable = false AND n.nullable = true THEN 'additive' WHEN o.pii <> n.pii THEN 'breaking' "
    "ELSE 'metadata' END AS classification, "
    "o.type || if(o.nullable IS FALSE, ' NOT NULL', '') || if(o.pii, ' PII', '') AS old_form, "
    "n.type || if(n.nullable IS FALSE, ' NOT NULL', '') || if(n.pii, ' PII', '') AS new_form "
    "FROM old_columns o FULL JOIN new_columns n USING (contract_id, name) "
    "WHERE (o.type, o.nullable, o.pii, o.description) IS DISTINCT FROM (n.type, n.nullable, n.pii, n.description)"
)
RULE_CHANGES = (
    "SELECT contract_id, 'quality_rules.' || name AS path, CASE WHEN o.severity IS NULL THEN 'added' "
    "WHEN n.severity IS NULL THEN 'removed' ELSE 'modified' END AS kind, "
    "if(o.severity IS NULL, 'additive', 'breaking') AS classification, "
    "o.severity || ': `' || o.assertion || '`' AS old_form, n.severity || ': `' || n.assertion || '`' AS new_form "
    "FROM old_rules o FULL JOIN new_rules n USING (contract_id, name) "
    "WHERE o.severity IS DISTINCT FROM n.severity OR o.assertion IS DISTINCT FROM n.assertion"
)
HEADER_CHANGES = " UNION ALL ".join(
    f"SELECT contract_id, '{path}' AS path, 'modified' AS kind, 'metadata' AS classification, "
    f"o.{field} AS old_form, n.{field} AS new_form FROM old_headers o JOIN new_headers n USING (contract_id) "
    f"WHERE o.{field} IS DISTINCT FROM n.{field}"
    for field, path in contract_diff.HEADER_PATHS.items()
)
CTES["column_changes"] = COLUMN_CHANGES
CTES["rule_changes"] = RULE_CHANGES
CTES["header_changes"] = HEADER_CHANGES
CTES["all_changes"] = (
    "SELECT * FROM column_changes UNION ALL SELECT * FROM rule_changes UNION ALL SELECT * FROM header_changes"
)
CTES["change_counts"] = (
    "SELECT contract_id, h.version, count(*) FILTER (WHERE classification = 'additive') AS additive, "
    "count(*) FILTER (WHERE classification = 'breaking') AS breaking, "
    "count(*) FILTER (WHERE classification = 'metadata') AS metadata "
    "FROM old_headers h LEFT JOIN all_changes USING (contract_id) GROUP BY contract_id, h.version"
)
CTES["promoted"] = (
    "SELECT *, CASE WHEN breaking > 0 THEN 'major' WHEN additive > 0 THEN 'minor' ELSE 'patch' END AS level, "
    "list_transform(string_split(version, '.'), lambda x: CAST(x AS INTEGER)) AS v, "
    "CASE WHEN breaking > 0 THEN (v[1] + 1) || '.0.0' WHEN additive > 0 THEN v[1] || '.' || (v[2] + 1) || '.0' "
    "ELSE v[1] || '.' || v[2] || '.' || (v[3] + 1) END AS next_version FROM change_counts"
)


def all_changes(registry: Registry) -> DataFrame:
    return (
        contract_diff.column_changes(registry.old_columns, registry.new_columns)
        .unionByName(contract_diff.rule_changes(registry.old_rules, registry.new_rules))
        .unionByName(contract_diff.header_changes(registry.old_headers, registry.new_headers))
    )


def summaries(registry: Registry) -> DataFrame:
    return contract_diff.summary(registry.old_headers, all_changes(registry))


CHANGE = ["contract_id", "path", "kind", "classification"]


@over_folder("contract_diff_schema", f"SELECT {', '.join(CHANGE)} FROM column_changes")
def _diff_schema(spark: SparkSession, folder: str) -> DataFrame:
    registry = Registry(spark, folder)
    return contract_diff.column_changes(registry.old_columns, registry.new_columns).select(CHANGE)


@over_folder("contract_diff_rules", f"SELECT {', '.join(CHANGE)} FROM rule_changes")
def _diff_rules(spark: SparkSession, folder: str) -> DataFrame:
    registry = Registry(spark, folder)
    return contract_diff.rule_changes(registry.old_rules, registry.new_rules).select(CHANGE)


@over_folder("contract_diff_meta", f"SELECT {', '.join(CHANGE)}, old_form AS old, new_form AS new FROM header_changes")
def _diff_meta(spark: SparkSession, folder: str) -> DataFrame:
    registry = Registry(spark, folder)
    return contract_diff.header_changes(registry.old_headers, registry.new_headers)


over_folder("contract_change_summary", "SELECT * FROM change_counts")(
    lambda spark, folder: summaries(Registry(spark, folder))
)

over_folder("contract_next_version", "SELECT * EXCLUDE (v) FROM promoted")(
    lambda spark, folder: contract_diff.next_versions(summaries(Registry(spark, folder)))
)


@over_folder(
    "contract_history",
    "SELECT contract_id, CAST(0 AS INTEGER) AS position, next_version AS version, additive || ' additive, ' || breaking "
    "|| ' breaking, ' || metadata || ' metadata' AS note FROM promoted UNION ALL "
    "SELECT contract_id, 1, version, 'Baseline.' FROM old_headers",
)
def _history(spark: SparkSession, folder: str) -> DataFrame:
    registry = Registry(spark, folder)
    return contract_diff.history(registry.old_headers, contract_diff.next_versions(summaries(registry)))


over_folder(
    "contract_diff_report",
    "SELECT contract_id, path, '| ' || path || ' | ' || kind || ' | **' || classification || '** | ' || "
    "coalesce(old_form, 'None') || ' → ' || coalesce(new_form, 'None') || ' |' AS line FROM all_changes",
)(lambda spark, folder: contract_diff.report(all_changes(Registry(spark, folder))))


# ------------------------------------------------------------------ contracts of one side, promotion, files

NUMBER = "CAST(replace(contract_id, 'ds_', '') AS BIGINT)"
NEW_ONLY, OLD_ONLY = f"{NUMBER} % 41 = 0", f"{NUMBER} % 43 = 0"
_FILLED = " + ".join(f"CAST({field} IS NOT NULL AS BIGINT)" for field in contract_diff.HEADER_PATHS)
CTES["one_sided"] = (
    "SELECT contract_id, '0.0.0' AS version, (SELECT count(*) FROM new_columns c WHERE c.contract_id = h.contract_id AND nullable IS NOT false) "
    "+ (SELECT count(*) FROM new_rules r WHERE r.contract_id = h.contract_id) AS additive, (SELECT count(*) FROM new_columns c "
    f"WHERE c.contract_id = h.contract_id AND nullable = false) AS breaking, {_FILLED} AS metadata FROM new_headers h "
    f"WHERE {NEW_ONLY} AND NOT {OLD_ONLY} UNION ALL SELECT contract_id, version, 0, (SELECT count(*) FROM old_columns c "
    "WHERE c.contract_id = h.contract_id) + (SELECT count(*) FROM old_rules r WHERE r.contract_id = h.contract_id), "
    f"{_FILLED} FROM old_headers h WHERE {OLD_ONLY} AND NOT {NEW_ONLY}"
)


@over_folder(
    "contract_one_sided",
    "SELECT contract_id, version, additive, breaking, metadata, CASE WHEN breaking > 0 THEN 'major' WHEN additive > 0 THEN 'minor' "
    "ELSE 'patch' END AS level, CASE WHEN breaking > 0 THEN (CAST(split_part(version, '.', 1) AS INTEGER) + 1) || '.0.0' WHEN additive > 0 "
    "THEN split_part(version, '.', 1) || '.' || (CAST(split_part(version, '.', 2) AS INTEGER) + 1) || '.0' ELSE split_part(version, '.', 1) "
    "|| '.' || split_part(version, '.', 2) || '.' || (CAST(split_part(version, '.', 3) AS INTEGER) + 1) END AS next_version FROM one_sided",
)
def _one_sided(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts that are proposed without a baseline, and contracts that are no longer proposed."""
    registry = Registry(spark, folder)

    def old(df: DataFrame) -> DataFrame:
        return df.filter(f"NOT ({NEW_ONLY})")

    def new(df: DataFrame) -> DataFrame:
        return df.filter(f"NOT ({OLD_ONLY})")

    changes = (
        contract_diff.column_changes(old(registry.old_columns), new(registry.new_columns))
        .unionByName(contract_diff.rule_changes(old(registry.old_rules), new(registry.new_rules)))
        .unionByName(contract_diff.header_changes(old(registry.old_headers), new(registry.new_headers)))
    )
    versions = contract_diff.next_versions(
        contract_diff.summary(old(registry.old_headers), changes, new(registry.new_headers))
    )
    return versions.filter(f"{NEW_ONLY} OR {OLD_ONLY}")


@over_folder(
    "contract_promotion",
    "SELECT contract_id, next_version AS version, owner, CAST(2 AS BIGINT) AS n_entries, next_version AS latest "
    "FROM promoted JOIN new_headers USING (contract_id)",
)
def _promotion(spark: SparkSession, folder: str) -> DataFrame:
    """All proposals promoted in one build; headers and change logs as read back from it."""
    registry, path = Registry(spark, folder), scratch_path(spark, "promotion")
    drop_at_exit(spark, path)
    headers = contract_diff.promote(path, registry.old_headers, registry.new_headers, all_changes(registry))
    log = read_current(spark, path, "contract_history").groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("n_entries"), F.min_by("version", "position").alias("latest")
    )
    return headers.join(log, "contract_id").select("contract_id", "version", "owner", "n_entries", "latest")


@over_folder(
    "contract_files",
    "SELECT contract_id, name, type, nullable, pii, description FROM old_columns SEMI JOIN old_headers USING (contract_id)",
)
def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The columns of all contracts, from contract files that are written and read."""
    registry, path = Registry(spark, folder), scratch_path(spark, "contracts")
    drop_at_exit(spark, path)
    written = contract_documents(registry.old_headers, registry.old_columns, registry.old_rules)
    write_json(written, path, "contracts")
    return contract_columns(read_contracts(spark, f"{path}/contracts", by_line=True)).drop("ordinal")


REPORTED = "ds_1"
_REPORT_HEAD = [f"# {REPORTED}", "", f"Not compared: {', '.join(contract_diff.IGNORED_PARTS)}.", "", *contract_diff.REPORT_HEAD]


@over_folder(
    "contract_report_file",
    f"SELECT unnest({_REPORT_HEAD}) AS line UNION ALL SELECT '| ' || path || ' | ' || kind || ' | **' || classification || '** | ' || "
    "coalesce(old_form, 'None') || ' → ' || coalesce(new_form, 'None') || ' |' FROM all_changes "
    f"WHERE contract_id = '{REPORTED}' UNION ALL SELECT '{contract_diff.NO_CHANGES}' "
    f"WHERE NOT EXISTS (FROM all_changes WHERE contract_id = '{REPORTED}')",
)
def _report_file(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a report file that was written."""
    path = scratch_path(spark, "reports")
    drop_at_exit(spark, path)
    write_report(contract_diff.document(all_changes(Registry(spark, folder)), REPORTED), path, f"{REPORTED}.md")
    return spark.read.text(f"{path}/{REPORTED}.md").withColumnRenamed("value", "line")


# ------------------------------------------------------------------ reviews

# The conversation table carries no verdicts, so a line is added to three turns in four.
REVIEW = (
    "text || CASE (conv_id + turn) % 4 WHEN 0 THEN chr(10) || 'VERDICT: APPROVE' "
    "WHEN 1 THEN chr(10) || 'Verdict:revise' WHEN 2 THEN chr(10) || 'VERDICT: maybe' ELSE '' END"
)


@over_folder(
    "review_verdicts",
    "SELECT conv_id, turn, CASE WHEN regexp_matches(review, '(?i)VERDICT:\\s*(APPROVE|REVISE)') "
    "THEN upper(regexp_extract(review, '(?i)VERDICT:\\s*(APPROVE|REVISE)', 1)) ELSE 'REVISE' END AS verdict "
    f"FROM (SELECT conv_id, turn, {REVIEW} AS review FROM conversations)",
)
def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.schema("conv_id BIGINT, turn BIGINT, role STRING, text STRING").parquet(
        f"{folder}/conversations.parquet"
    )
    return turns.selectExpr("conv_id", "turn", f"{REVIEW} AS review").select(
        "conv_id", "turn", verdict(F.col("review")).alias("verdict")
    )
