"""The silver and gold models. Each takes the DataFrames it depends on and returns one.

`as_of` is the moment the run counts as now; no model reads the clock.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.functions.dates import earliest_birth, latest_adult_birth, month_of, naive_timestamp
from touchstone.functions.text import capitalised, code, plausible_email
from touchstone.operators.copies import COPY_NUMBER, keys, number_copies, tally

UNKNOWN_CUSTOMER = 0

# The stand-in customer that unresolved accounts point to.
UNKNOWN_MEMBER = {
    "customer_id": UNKNOWN_CUSTOMER,
    "first_name": "Unknown",
    "last_name": "Member",
    "email": None,
    "date_of_birth": None,
    "city": None,
    "kyc_status": None,
    "risk_rating": None,
    "created_at": "1900-01-01",
}

# Spellings of the account types, the score that means "not scored", and the
# amount from which a transaction is large.
ACCOUNT_TYPES = {"CURRENT": ["CURRENT", "CUR"], "SAVINGS": ["SAVINGS", "SAV"]}
NOT_SCORED = 99
LARGE_AMOUNT = 10000


def acceptable_birth() -> Column:
    """True for a missing birth date or an adult one; NULL when the onboarding day is missing."""
    birth = F.col("date_of_birth")
    return birth.isNull() | birth.between(earliest_birth(), latest_adult_birth(F.col("created_at")))


def unknown_member(like: DataFrame) -> DataFrame:
    row = like.sparkSession.range(0, 1, 1, 1)
    return row.select(
        *[F.lit(UNKNOWN_MEMBER[f.name]).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    )


def silver_customers(bronze: DataFrame) -> DataFrame:
    cleaned = (
        bronze.filter(acceptable_birth())
        .distinct()
        .withColumns(
            {
                "first_name": capitalised(F.col("first_name")),
                "last_name": capitalised(F.col("last_name")),
                "email": plausible_email(F.col("email")),
                "city": capitalised(F.col("city")),
                "kyc_status": code(F.col("kyc_status")),
                "risk_rating": F.nullif(F.col("risk_rating"), F.lit(NOT_SCORED)),
            }
        )
    )
    return cleaned.unionByName(unknown_member(cleaned))


def rejection_reason() -> Column:
    birth, onboarded = F.col("date_of_birth"), F.col("created_at")
    # The reason codes, in order of precedence.
    return (
        F.when(birth < earliest_birth(), "DOB_IMPLAUSIBLE")
        .when(birth > onboarded, "DOB_AFTER_ONBOARDING")
        .when(birth > latest_adult_birth(onboarded), "MINOR_AT_ONBOARDING")
        .otherwise("UNKNOWN")
    )


def _stamp(rejects: DataFrame, model: str, as_of: datetime) -> DataFrame:
    return rejects.withColumns({"rejected_by": F.lit(model), "rejected_at": naive_timestamp(as_of)})


def silver_customers_rejected(bronze: DataFrame, silver: DataFrame, as_of: datetime) -> DataFrame:
    """Every bronze row that is not in silver: later copies, and first copies without a silver id.

    A first copy that passes the birth rule is in silver under its own id, so only failing rows
    and rows without an id have to be looked up.
    """
    repeats = number_copies(tally(bronze), first=2).drop(COPY_NUMBER)
    suspects = bronze.filter(~F.coalesce(acceptable_birth(), F.lit(False)) | F.col("customer_id").isNull())
    failures = suspects.distinct().join(keys(silver, "customer_id"), "customer_id", "left_anti")
    rejects = repeats.withColumn("reason_code", F.lit("DUPLICATE_ROW")).unionByName(
        failures.withColumn("reason_code", rejection_reason())
    )
    return _stamp(rejects, "silver_customers", as_of)


def silver_accounts(bronze: DataFrame, customers: DataFrame) -> DataFrame:
    """All accounts; one whose customer is not in silver points to the unknown member."""
    spelled = F.upper(F.trim("account_type"))
    kind = F.lit(None).cast("string")
    for name, spellings in ACCOUNT_TYPES.items():
        kind = F.when(spelled.isin(spellings), name).otherwise(kind)
    known = customers.select(F.col("customer_id").alias("_known"))
    return bronze.join(known, F.col("customer_id") == F.col("_known"), "left").select(
        "account_id",
        F.coalesce("_known", F.lit(UNKNOWN_CUSTOMER).cast("bigint")).alias("customer_id"),
        kind.alias("account_type"),
        F.round("balance", 2).alias("balance"),
        "currency",
        "opened_date",
        code(F.col("status")).alias("status"),
    )


def silver_accounts_rejected(
    bronze: DataFrame, bronze_customers: DataFrame, customers: DataFrame, as_of: datetime
) -> DataFrame:
    """Accounts that point to the unknown member, with the reason.

    Both customer lists are merged into one standing per id first, so the accounts are joined once.
    """
    landed = bronze_customers.select("customer_id", F.lit(False).alias("accepted"))
    cleaned = customers.select("customer_id", F.lit(True).alias("accepted"))
    standing = (
        landed.unionByName(cleaned)
        .groupBy(F.col("customer_id").alias("_id"))
        .agg(F.bool_or("accepted").alias("_accepted"), F.bool_or(~F.col("accepted")).alias("_landed"))
    )
    rejects = (
        bronze.join(standing, F.col("customer_id") == F.col("_id"), "left")
        .filter(~F.coalesce("_accepted", F.lit(False)))
        .withColumn(
            "reason_code",
            F.when(F.col("_landed"), "CUSTOMER_REJECTED_UPSTREAM").otherwise("ORPHAN_CUSTOMER"),
        )
        .drop("_id", "_accepted", "_landed")
    )
    return _stamp(rejects, "silver_accounts", as_of)


def conformed_transactions(bronze: DataFrame, as_of: datetime) -> DataFrame:
    """Distinct transactions up to `as_of`, conformed, whether or not their account is known."""
    return (
        bronze.filter(F.col("txn_ts") <= naive_timestamp(as_of))
        .distinct()
        .withColumns(
            {
                "amount": F.round("amount", 2),
                "currency": F.upper("currency"),
                "channel": code(F.col("channel")),
            }
        )
    )


def silver_transactions(bronze: DataFrame, accounts: DataFrame, as_of: datetime) -> DataFrame:
    # Distinct ids let Catalyst drop the customer join that the accounts went through.
    return conformed_transactions(bronze, as_of).join(keys(accounts, "account_id"), "account_id", "left_semi").select(
        *bronze.columns
    )


def account_activity(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per customer and account, with its balance and its transaction counts.

    Transactions are counted per account before the join, which then adds no rows.
    """
    counts = transactions.groupBy(F.col("account_id").alias("_account")).agg(
        F.count("txn_id").alias("n_txns"),
        F.count_if(F.col("amount") >= LARGE_AMOUNT).alias("n_large_txns"),
    )
    held = accounts.groupBy("customer_id", "account_id").agg(
        F.sum("balance").alias("balance"), F.count(F.lit(1)).alias("_rows")
    )
    none = F.lit(0).cast("bigint")
    return held.join(counts, F.col("account_id") == F.col("_account"), "left").select(
        "customer_id",
        "account_id",
        "balance",
        F.coalesce(F.col("n_txns") * F.col("_rows"), none).alias("n_txns"),
        F.coalesce(F.col("n_large_txns") * F.col("_rows"), none).alias("n_large_txns"),
        F.col("_rows").alias("n_rows"),
    )


def gold_customer_360(customers: DataFrame, accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per customer with account and transaction totals, zero where there are none.

    `transactions` may be conformed rather than silver ones: a transaction without a silver
    account joins no account and so does not count.
    """
    totals = (
        account_activity(accounts, transactions)
        .groupBy(F.col("customer_id").alias("_owner"))
        .agg(
            F.count("account_id").alias("n_accounts"),
            F.round(F.sum("balance"), 2).alias("total_balance"),
            F.sum("n_txns").alias("n_txns"),
            F.sum("n_large_txns").alias("n_large_txns"),
        )
    )
    none = F.lit(0).cast("bigint")
    return customers.join(totals, F.col("customer_id") == F.col("_owner"), "left").select(
        "customer_id",
        "first_name",
        "last_name",
        "city",
        "kyc_status",
        "risk_rating",
        F.coalesce("n_accounts", none).alias("n_accounts"),
        F.coalesce("total_balance", F.lit(0.0)).alias("total_balance"),
        F.coalesce("n_txns", none).alias("n_txns"),
        F.coalesce("n_large_txns", none).alias("n_large_txns"),
    )


def gold_monthly_channel_volume(transactions: DataFrame) -> DataFrame:
    """Count and gross value per month and channel; a missing channel is a group of its own."""
    return (
        transactions.groupBy(month_of(F.col("txn_ts")).alias("month"), "channel")
        .agg(F.count(F.lit(1)).alias("n_txns"), F.round(F.sum(F.abs("amount")), 2).alias("gross_value"))
        .orderBy("month", "channel")
    )


def fanout_check(accounts: DataFrame, transactions: DataFrame) -> DataFrame:
    """Per customer, the balance total and what it becomes when accounts are joined to their
    transactions before summing. The joined rows are counted, not built."""
    # An account listed twice has its balance and its transactions counted twice already.
    repeated = F.col("balance") * F.greatest(F.expr("n_txns div n_rows"), F.lit(1))
    return (
        account_activity(accounts, transactions)
        .groupBy("customer_id")
        .agg(
            F.round(F.sum("balance"), 2).alias("right_total"),
            F.round(F.sum(repeated), 2).alias("fanned_out_total"),
        )
    )


# The segments by risk rating and the relabelled status.
def evolve_customers(customers: DataFrame) -> DataFrame:
    """The next version of the table: two more columns and a status outside the agreed list.

    Columns that are already there are left as they are.
    """
    remainder = F.col("customer_id") % 5
    added = {
        "marketing_consent": F.when(remainder != 4, remainder < 2),
        "customer_segment": F.when(F.col("risk_rating") >= 4, "BUSINESS")
        .when(F.col("risk_rating") == 3, "PREMIER")
        .otherwise("RETAIL"),
    }
    expired = (F.col("kyc_status") == "REJECTED") & (F.col("customer_id") % 2 == 0)
    return customers.withColumns({n: c for n, c in added.items() if n not in customers.columns}).withColumn(
        "kyc_status", F.when(expired, "EXPIRED").otherwise(F.col("kyc_status"))
    )
