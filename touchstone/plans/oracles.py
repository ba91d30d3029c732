"""The same results as plain SQL for DuckDB, to check the Spark plans against.

Each statement is written for itself, over the raw test tables; a shared table is a CTE that is
put in front of the statements that name it.
"""

from __future__ import annotations

import re

from touchstone.sources.derived import derive_sql
from touchstone.sources.registry import registry_sql

AS_OF = "TIMESTAMP '2004-01-01 00:00:00'"


def _whole_text_capital(column: str) -> str:
    return f"upper(left(trim({column}), 1)) || lower(trim({column})[2:])"


def _code(column: str) -> str:
    return f"CASE WHEN length(trim({column})) > 0 THEN upper(trim({column})) END"


ADULT_BY = "CAST(created_at - INTERVAL 18 YEAR AS DATE)"
BIRTH_OK = f"(date_of_birth IS NULL OR (date_of_birth >= DATE '1910-01-01' AND date_of_birth <= {ADULT_BY}))"
CUSTOMER_COLUMNS = (
    "customer_id, first_name, last_name, email, date_of_birth, city, kyc_status, risk_rating, created_at"
)

CTES: dict[str, str] = {
    "bronze_customers": derive_sql("bronze_customers"),
    "bronze_accounts": derive_sql("bronze_accounts"),
    "bronze_transactions": derive_sql("bronze_transactions"),
    # Every landed customer row with its copy number.
    "customer_copies": (
        f"SELECT {CUSTOMER_COLUMNS}, unnest(range(1, count(*) + 1)) AS copy_number "
        f"FROM bronze_customers GROUP BY {CUSTOMER_COLUMNS}"
    ),
    "silver_customers": (
        f"SELECT customer_id, {_whole_text_capital('first_name')} AS first_name, "
        f"{_whole_text_capital('last_name')} AS last_name, "
        "CASE WHEN contains(email, '@') AND regexp_matches(email, '@.*\\.') THEN lower(email) END AS email, "
        f"date_of_birth, {_whole_text_capital('city')} AS city, {_code('kyc_status')} AS kyc_status, "
        "CASE WHEN risk_rating <> 99 THEN risk_rating END AS risk_rating, created_at "
        f"FROM customer_copies WHERE copy_number = 1 AND {BIRTH_OK} "
        "UNION ALL SELECT 0, 'Unknown', 'Member', NULL, NULL, NULL, NULL, NULL, DATE '1900-01-01'"
    ),
    "silver_customers_rejected": (
        f"SELECT {CUSTOMER_COLUMNS}, CASE WHEN copy_number > 1 THEN 'DUPLICATE_ROW' "
        "WHEN date_of_birth < DATE '1910-01-01' THEN 'DOB_IMPLAUSIBLE' "
        "WHEN date_of_birth > created_at THEN 'DOB_AFTER_ONBOARDING' "
        f"WHEN date_of_birth > {ADULT_BY} THEN 'MINOR_AT_ONBOARDING' ELSE 'UNKNOWN' END AS reason_code, "
        "'silver_customers' AS rejected_by FROM customer_copies WHERE copy_number > 1 OR customer_id IS NULL "
        "OR customer_id NOT IN (SELECT customer_id FROM silver_customers WHERE customer_id IS NOT NULL)"
    ),
    "silver_accounts": (
        "SELECT account_id, CASE WHEN s.customer_id IS NULL THEN 0 ELSE s.customer_id END AS customer_id, "
        "CASE WHEN regexp_matches(upper(trim(account_type)), '^CUR(RENT)?$') THEN 'CURRENT' "
        "WHEN regexp_matches(upper(trim(account_type)), '^SAV(INGS)?$') THEN 'SAVINGS' END AS account_type, "
        f"round(balance, 2) AS balance, currency, opened_date, {_code('status')} AS status "
        "FROM bronze_accounts AS b LEFT JOIN silver_customers AS s USING (customer_id)"
    ),
    "silver_accounts_rejected": (
        "SELECT *, CASE WHEN customer_id IN (SELECT customer_id FROM bronze_customers) "
        "THEN 'CUSTOMER_REJECTED_UPSTREAM' ELSE 'ORPHAN_CUSTOMER' END AS reason_code, "
        "'silver_accounts' AS rejected_by FROM bronze_accounts "
        "WHERE customer_id NOT IN (SELECT customer_id FROM silver_customers)"
    ),
    "silver_transactions": (
        f"SELECT txn_id, account_id, round(amount, 2) AS amount, upper(currency) AS currency, txn_ts, "
        f"{_code('channel')} AS channel, merchant_category_code FROM bronze_transactions "
        f"WHERE txn_ts <= {AS_OF} AND account_id IN (SELECT account_id FROM silver_accounts) "
        "GROUP BY bronze_transactions.txn_id, bronze_transactions.account_id, bronze_transactions.amount, "
        "bronze_transactions.currency, bronze_transactions.txn_ts, bronze_transactions.channel, "
        "bronze_transactions.merchant_category_code"
    ),
    "gold_customer_360": (
        "SELECT customer_id, first_name, last_name, city, kyc_status, risk_rating, "
        "(SELECT count(DISTINCT account_id) FROM silver_accounts a WHERE a.customer_id = c.customer_id) AS n_accounts, "
        "ifnull(round((SELECT sum(balance) FROM silver_accounts a WHERE a.customer_id = c.customer_id), 2), 0.0) "
        "AS total_balance, "
        "(SELECT count(txn_id) FROM owned_transactions t WHERE t.owner = c.customer_id) AS n_txns, "
        "(SELECT count(*) FROM owned_transactions t WHERE t.owner = c.customer_id AND amount >= 10000) AS n_large_txns "
        "FROM silver_customers c"
    ),
    "owned_transactions": (
        "SELECT a.customer_id AS owner, t.* FROM silver_transactions t, silver_accounts a "
        "WHERE t.account_id = a.account_id"
    ),
    "gold_monthly_channel_volume": (
        "SELECT CAST(make_date(year(txn_ts), month(txn_ts), 1) AS TIMESTAMP) AS month, channel, "
        "count(*) AS n_txns, round(sum(abs(amount)), 2) AS gross_value "
        "FROM silver_transactions GROUP BY year(txn_ts), month(txn_ts), channel"
    ),
    "evolved_customers": (
        "SELECT * REPLACE (CASE WHEN kyc_status = 'REJECTED' AND customer_id % 2 = 0 THEN 'EXPIRED' "
        "ELSE kyc_status END AS kyc_status), "
        "CASE customer_id % 5 WHEN 4 THEN NULL WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS marketing_consent, "
        "CASE WHEN risk_rating IN (4, 5) THEN 'BUSINESS' WHEN risk_rating = 3 THEN 'PREMIER' ELSE 'RETAIL' END "
        "AS customer_segment FROM silver_customers"
    ),
}

CTES |= registry_sql()


def statement(body: str) -> str:
    """A statement with the shared tables it names, directly or through others, in front."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in found:
                    found.append(name)

    visit(body)
    if not found:
        return body
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in found) + " " + body
