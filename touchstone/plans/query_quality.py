"""Queries: contract rules, data tests, the landed-customer ruleset and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.functions.dates import naive_timestamp
from touchstone.operators import quality
from touchstone.plans.lakehouse import Lakehouse
from touchstone.plans.registry import over_tables


def _rule_oracle(rule: str, condition: str, table: str = "silver_customers", severity: str = "blocking") -> str:
    return (
        f"SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) AS rows_checked, "
        f"count(*) FILTER (WHERE {condition}) AS violations FROM {table}"
    )


# ------------------------------------------------------------------ rules on silver customers

SILVER_RULES = {
    "rule_names_present": ("names_present", "NOT (first_name IS NOT NULL AND last_name IS NOT NULL)"),
    "rule_kyc_enum": (
        "kyc_status_enum",
        "NOT (kyc_status = 'VERIFIED' OR kyc_status = 'PENDING' OR kyc_status = 'REJECTED')",
    ),
    "rule_risk_range": ("risk_rating_range", "risk_rating < 1 OR risk_rating > 5"),
    "rule_adult": ("adult_at_onboarding", "CAST(created_at - INTERVAL 18 YEAR AS DATE) < date_of_birth"),
    "rule_names_required": (
        "names_required",
        "NOT coalesce(length(trim(first_name)) > 0 AND length(trim(last_name)) > 0, false)",
    ),
    "rule_dob_before_onboarding": ("dob_before_onboarding", "NOT (date_of_birth < created_at)"),
    "rule_email_format": ("email_format", "NOT regexp_full_match(email, '.+@..+[.]..+')"),
    "rule_known_city": (
        "known_city",
        "NOT list_contains(['London', 'Manchester', 'Birmingham', 'Leeds', 'Bristol', 'Glasgow'], city)",
    ),
}

for _key, (_rule, _condition) in SILVER_RULES.items():
    over_tables(_key, _rule_oracle(_rule, _condition))(
        lambda lake, r=_rule: quality.violations(lake["silver_customers"], [quality.CUSTOMER_RULES[r]])
    )

over_tables(
    "rule_created_at_required",
    _rule_oracle("created_at_required", "NOT coalesce(created_at <= DATE '2004-01-01', false)"),
)(lambda lake: quality.violations(lake["silver_customers"], [quality.created_at_required(lake.as_of)]))

over_tables(
    "rule_pk",
    "SELECT (SELECT count(*) FROM silver_customers WHERE customer_id IS NULL) AS null_keys, "
    "(SELECT count(*) FROM (SELECT customer_id FROM silver_customers WHERE customer_id IS NOT NULL "
    "GROUP BY customer_id HAVING count(*) > 1)) AS repeated_keys",
)(lambda lake: quality.key_violations(lake["silver_customers"], "customer_id"))

over_tables(
    "rule_row_conservation",
    "SELECT n_bronze, n_silver, n_rejected, abs(n_bronze - n_silver - n_rejected) AS violations FROM ("
    "SELECT (SELECT count(*) FROM bronze_customers) AS n_bronze, "
    "(SELECT count(*) FROM silver_customers WHERE customer_id > 0) AS n_silver, "
    "(SELECT count(*) FROM silver_customers_rejected) AS n_rejected)",
)(
    lambda lake: quality.row_conservation(
        lake["bronze_customers"], lake["silver_customers"], lake["silver_customers_rejected"]
    )
)

over_tables(
    "rule_unknown_member",
    "SELECT abs(1 - count(*)) AS violations FROM silver_customers WHERE customer_id = 0",
)(lambda lake: quality.unknown_member_count(lake["silver_customers"]))


# ------------------------------------------------------------------ generic data tests

# Which columns each test covers, and the reason codes.
NOT_NULL = {
    "silver_customers": ["customer_id", "first_name", "last_name"],
    "silver_customers_rejected": ["reason_code"],
    "silver_accounts": ["account_id", "customer_id"],
    "silver_accounts_rejected": ["reason_code"],
    "silver_transactions": ["txn_id", "account_id"],
    "gold_customer_360": ["customer_id", "total_balance"],
    "gold_monthly_channel_volume": ["month"],
}
UNIQUE = {"silver_customers": "customer_id", "silver_accounts": "account_id", "gold_customer_360": "customer_id"}
REASONS = {
    "silver_customers_rejected": [
        "DUPLICATE_ROW",
        "DOB_IMPLAUSIBLE",
        "DOB_AFTER_ONBOARDING",
        "MINOR_AT_ONBOARDING",
        "UNKNOWN",
    ],
    "silver_accounts_rejected": ["ORPHAN_CUSTOMER", "CUSTOMER_REJECTED_UPSTREAM"],
}


def _test_oracle(test: str, table: str, column: str, failures: str) -> str:
    return (
        f"SELECT '{test}' AS test, '{table}' AS table_name, '{column}' AS column_name, ({failures}) AS failures"
    )


@over_tables(
    "test_not_null",
    " UNION ALL ".join(
        _test_oracle("not_null", t, c, f"SELECT count(*) FROM {t} WHERE {c} IS NULL")
        for t, columns in NOT_NULL.items()
        for c in columns
    ),
)
def _not_null(lake: Lakehouse) -> DataFrame:
    return reduce(DataFrame.unionByName, [quality.not_null(lake[t], t, c) for t, c in NOT_NULL.items()])


@over_tables(
    "test_unique",
    " UNION ALL ".join(
        _test_oracle("unique", t, c, f"SELECT count(*) FROM (SELECT {c} FROM {t} GROUP BY {c} HAVING count({c}) > 1)")
        for t, c in UNIQUE.items()
    ),
)
def _unique(lake: Lakehouse) -> DataFrame:
    return reduce(DataFrame.unionByName, [quality.unique(lake[t], t, c) for t, c in UNIQUE.items()])


@over_tables(
    "test_accepted_values",
    " UNION ALL ".join(
        _test_oracle(
            "accepted_values",
            t,
            "reason_code",
            f"SELECT count(*) FROM {t} WHERE NOT list_contains({reasons}, reason_code)",
        )
        for t, reasons in REASONS.items()
    ),
)
def _accepted_values(lake: Lakehouse) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [quality.accepted_values(lake[t], t, "reason_code", reasons) for t, reasons in REASONS.items()],
    )


@over_tables(
    "test_relationships",
    " UNION ALL ".join(
        _test_oracle(
            "relationships",
            t,
            "account_id",
            f"SELECT count(*) FROM {t} WHERE account_id NOT IN (SELECT account_id FROM silver_accounts)",
        )
        for t in ["silver_transactions", "bronze_transactions"]
    ),
)
def _relationships(lake: Lakehouse) -> DataFrame:
    """The silver table, which must pass, and the landed one, which shows what was dropped."""
    return reduce(
        DataFrame.unionByName,
        [
            quality.relationships(lake[t], lake["silver_accounts"], t, "account_id", "account_id")
            for t in ["silver_transactions", "bronze_transactions"]
        ],
    )


# ------------------------------------------------------------------ ruleset for landed customers

ROW_CONDITIONS = {
    "R3": "customer_id IS NULL OR first_name IS NULL OR last_name IS NULL",
    "R5": "NOT coalesce(regexp_full_match(upper(trim(kyc_status)), 'VERIFIED|PENDING|REJECTED'), false)",
    "R6": "risk_rating < 1 OR risk_rating > 5",
    "R7": "NOT regexp_full_match(email, '.+@..+[.]..+')",
    "R8": "NOT regexp_full_match(upper(trim(city)), 'LONDON|MANCHESTER|BIRMINGHAM|LEEDS|BRISTOL|GLASGOW')",
    "R9": "created_at < date_of_birth",
    "R10": "CAST(created_at - INTERVAL 18 YEAR AS DATE) < date_of_birth",
    "R11": "date_of_birth < DATE '1900-01-01' OR date_of_birth > DATE '2004-01-01'",
}

for _id in ["R3", "R5", "R6", "R7", "R9", "R10", "R11"]:
    _severity = "warning" if _id in quality.GATE_WARNING else "blocking"
    over_tables(f"dq_{_id.lower()}", _rule_oracle(_id, ROW_CONDITIONS[_id], "bronze_customers", _severity))(
        lambda lake, i=_id: quality.violations(
            lake["bronze_customers"], [quality.landed_customer_rules(lake.as_of)[i]]
        )
    )

over_tables(
    "dq_r1",
    "SELECT customer_id, count(*) AS n_rows FROM bronze_customers GROUP BY customer_id HAVING count(*) >= 2",
)(lambda lake: quality.repeated_ids(lake["bronze_customers"]))

over_tables("dq_r2", "SELECT *, count(*) AS n_rows FROM bronze_customers GROUP BY ALL HAVING n_rows >= 2")(
    lambda lake: quality.repeated_rows(lake["bronze_customers"])
)

over_tables(
    "dq_r4",
    "SELECT "
    + ", ".join(
        f"round(100.0 * (count(*) - count({value})) / count(*), 1) AS {name}_null_pct"
        for name, value in {
            "email": "email",
            "dob": "date_of_birth",
            "city": "city",
            "kyc": "nullif(kyc_status, '')",
            "risk": "risk_rating",
        }.items()
    )
    + " FROM bronze_customers",
)(lambda lake: quality.null_rates(lake["bronze_customers"]))

over_tables(
    "dq_r8",
    f"SELECT count(*) FILTER (WHERE {ROW_CONDITIONS['R8']}) AS n_rows, count(DISTINCT city) FILTER "
    f"(WHERE {ROW_CONDITIONS['R8']}) AS n_cities, count(DISTINCT city) AS n_spellings FROM bronze_customers",
)(lambda lake: quality.city_spellings(lake["bronze_customers"], lake.as_of))

over_tables(
    "dq_r8_cities",
    f"SELECT city, count(*) AS n_rows FROM bronze_customers WHERE {ROW_CONDITIONS['R8']} GROUP BY city",
)(lambda lake: quality.unknown_cities(lake["bronze_customers"], lake.as_of))

over_tables(
    "dq_r12",
    "SELECT email, count(*) AS n_customers FROM (SELECT DISTINCT email, customer_id FROM bronze_customers "
    "WHERE email IS NOT NULL AND customer_id IS NOT NULL) GROUP BY email HAVING count(*) > 1",
)(lambda lake: quality.shared_emails(lake["bronze_customers"]))

over_tables(
    "dq_value_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS n_rows FROM bronze_customers GROUP BY {c}"
        for c in ["kyc_status", "risk_rating", "city"]
    ),
)(lambda lake: quality.value_counts(lake["bronze_customers"], ["kyc_status", "risk_rating", "city"]))

over_tables(
    "dq_gate",
    "SELECT *, CASE WHEN length(blocking_rules) > 0 THEN 'QUARANTINE' ELSE 'LOAD' END AS action FROM ("
    "SELECT *, concat_ws(',', CASE WHEN count(*) OVER (PARTITION BY customer_id) > 1 THEN 'R1' END, "
    f"CASE WHEN {ROW_CONDITIONS['R9']} THEN 'R9' END, CASE WHEN {ROW_CONDITIONS['R10']} THEN 'R10' END) "
    "AS blocking_rules, concat_ws(',', CASE WHEN email IS NULL OR date_of_birth IS NULL OR city IS NULL "
    "OR nullif(kyc_status, '') IS NULL OR risk_rating IS NULL THEN 'R4' END, "
    f"CASE WHEN {ROW_CONDITIONS['R8']} THEN 'R8' END, CASE WHEN {ROW_CONDITIONS['R11']} THEN 'R11' END, "
    "CASE WHEN email IS NOT NULL AND min(customer_id) OVER (PARTITION BY email) <> max(customer_id) OVER "
    "(PARTITION BY email) THEN 'R12' END) AS warning_rules FROM bronze_customers)",
)(lambda lake: quality.gate(lake["bronze_customers"], lake.as_of))


# ------------------------------------------------------------------ reconciliation

over_tables(
    "recon_accounts",
    "SELECT count(*) AS n_bronze, (SELECT count(*) FROM silver_accounts) AS n_silver, "
    "count(*) = (SELECT count(*) FROM silver_accounts) AS balanced FROM bronze_accounts",
)(
    lambda lake: quality.side_by_side(
        n_bronze=quality.row_count(lake["bronze_accounts"]), n_silver=quality.row_count(lake["silver_accounts"])
    ).withColumn("balanced", F.col("n_bronze") == F.col("n_silver"))
)

over_tables(
    "recon_balances",
    "SELECT round(sum(balance), 2) AS silver_total, "
    "(SELECT round(sum(total_balance), 2) FROM gold_customer_360) AS gold_total, "
    "abs(sum(balance) - (SELECT sum(total_balance) FROM gold_customer_360)) < 0.5 AS balanced FROM silver_accounts",
)(
    lambda lake: quality.side_by_side(
        silver_total=lake["silver_accounts"].agg(F.round(F.sum("balance"), 2).alias("v")),
        gold_total=lake["gold_customer_360"].agg(F.round(F.sum("total_balance"), 2).alias("v")),
    ).withColumn("balanced", F.abs(F.col("silver_total") - F.col("gold_total")) < 0.5)
)


@over_tables(
    "quarantine_totals",
    "SELECT 'silver_accounts_rejected' AS table_name, reason_code, count(*) AS n_rows, "
    "round(sum(balance), 2) AS balance FROM silver_accounts_rejected GROUP BY reason_code UNION ALL "
    "SELECT 'silver_customers_rejected', reason_code, count(*), NULL FROM silver_customers_rejected GROUP BY reason_code",
)
def _quarantine_totals(lake: Lakehouse) -> DataFrame:
    def totals(name: str, balance) -> DataFrame:
        return (
            lake[name]
            .groupBy("reason_code")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(balance), 2).alias("balance"))
            .withColumn("table_name", F.lit(name))
        )

    accounts = totals("silver_accounts_rejected", F.col("balance"))
    return accounts.unionByName(totals("silver_customers_rejected", F.lit(None).cast("double")))


over_tables(
    "recon_transactions",
    "SELECT CASE WHEN copy > 1 THEN 'DUPLICATE' WHEN account_id NOT IN (SELECT account_id FROM silver_accounts) "
    "THEN 'UNKNOWN_ACCOUNT' WHEN txn_ts > TIMESTAMP '2004-01-01' THEN 'FUTURE_DATED' ELSE 'LOADED' END AS cause, "
    "count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, account_id, amount, currency, "
    "txn_ts, channel, merchant_category_code) AS copy FROM bronze_transactions) GROUP BY cause",
)(
    lambda lake: quality.transaction_losses(
        lake["bronze_transactions"],
        lake["silver_accounts"],
        F.col("txn_ts") <= naive_timestamp(lake.as_of),
    )
)

over_tables(
    "conflicting_duplicates",
    "SELECT txn_id, count(*) AS n_versions FROM (SELECT DISTINCT * FROM bronze_transactions) "
    "GROUP BY txn_id HAVING count(*) > 1",
)(lambda lake: quality.conflicting_ids(lake["bronze_transactions"], "txn_id"))
