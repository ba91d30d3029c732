"""Data-quality rules and data tests.

All row rules of a table are counted in one aggregate, so a table is read once however many
rules it has. Rules about groups count the groups first, which combines equal rows per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.operators.copies import COPIES, keys, tally


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where the SQL condition is true; an undecided condition passes."""

    name: str
    violation: str
    severity: str = "blocking"


# The agreed statuses, rating range, cities, and e-mail pattern.
KYC_STATUSES = "'VERIFIED', 'PENDING', 'REJECTED'"
RATINGS = "1 AND 5"
CITIES = "'London', 'Manchester', 'Birmingham', 'Leeds', 'Bristol', 'Glasgow'"
EMAIL_PATTERN = "'%_@__%.__%'"

CUSTOMER_RULES = {
    rule.name: rule
    for rule in [
        Rule("names_present", "first_name IS NULL OR last_name IS NULL"),
        Rule("kyc_status_enum", f"kyc_status NOT IN ({KYC_STATUSES})"),
        Rule("risk_rating_range", f"risk_rating NOT BETWEEN {RATINGS}"),
        Rule("adult_at_onboarding", "date_of_birth > created_at - INTERVAL 18 YEAR"),
        Rule("names_required", "coalesce(trim(first_name), '') = '' OR coalesce(trim(last_name), '') = ''"),
        Rule("dob_before_onboarding", "date_of_birth >= created_at"),
        Rule("email_format", f"email NOT LIKE {EMAIL_PATTERN}"),
        Rule("known_city", f"city NOT IN ({CITIES})"),
    ]
}


def created_at_required(as_of: datetime) -> Rule:
    return Rule("created_at_required", f"created_at IS NULL OR created_at > DATE '{as_of:%Y-%m-%d}'")


def violations(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rows checked and rows that break it."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.expr(rule.violation)).alias(f"_rule_{i}") for i, rule in enumerate(rules)],
    )
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(rule.name).alias("rule"),
                        F.lit(rule.severity).alias("severity"),
                        F.col("_rows").alias("rows_checked"),
                        F.col(f"_rule_{i}").alias("violations"),
                    )
                    for i, rule in enumerate(rules)
                ]
            )
        )
    )


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Rows without a key, and keys that occur more than once."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    missing = F.col(key).isNull()
    return per_key.agg(
        F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0).cast("bigint")).alias("null_keys"),
        F.count_if(~missing & (F.col("_n") > 1)).alias("repeated_keys"),
    )


def side_by_side(**parts: DataFrame) -> DataFrame:
    """Several one-value results as the columns of one row."""
    rows = [
        df.select(F.lit(name).alias("_part"), F.col(df.columns[0]).alias("_value")) for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, rows).agg(
        *[F.max(F.when(F.col("_part") == name, F.col("_value"))).alias(name) for name in parts]
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    counts = [df.selectExpr(f"'{name}' AS table_name", "count(*) AS n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


# ------------------------------------------------------------------ generic data tests


def _outcome(test: str, table: str, column: str, failures: DataFrame) -> DataFrame:
    return failures.select(
        F.lit(test).alias("test"),
        F.lit(table).alias("table_name"),
        F.lit(column).alias("column_name"),
        F.col(failures.columns[0]).alias("failures"),
    )


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "failures").select(
        F.lit("not_null").alias("test"), F.lit(table).alias("table_name"), "column_name", "failures"
    )


def unique(df: DataFrame, table: str, column: str) -> DataFrame:
    """Counts the values that occur more than once."""
    repeated = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1")
    return _outcome("unique", table, column, row_count(repeated))


def accepted_values(df: DataFrame, table: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts the rows outside the list; a missing value is left to the not-null test."""
    return _outcome(
        "accepted_values", table, column, df.agg(F.count_if(~F.col(column).isin(list(values))).alias("failures"))
    )


def relationships(child: DataFrame, parent: DataFrame, table: str, column: str, parent_column: str) -> DataFrame:
    """Counts the child rows whose key has no parent.

    Child rows are counted per key before the join, so a frequent key is one row in it.
    """
    held = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    known = keys(parent, parent_column).withColumnRenamed(parent_column, "_key")
    lost = held.join(known, "_key", "left_anti").agg(F.coalesce(F.sum("_n"), F.lit(0).cast("bigint")).alias("failures"))
    return _outcome("relationships", table, column, lost)


# ------------------------------------------------------------------ ruleset for landed customers

# Ids and severities. R1, R9 and R10 hold a row back, the others warn.
GATE_BLOCKING = ["R1", "R9", "R10"]
GATE_WARNING = ["R4", "R8", "R11", "R12"]

MONITORED = {
    "email": "email IS NULL",
    "dob": "date_of_birth IS NULL",
    "city": "city IS NULL",
    "kyc": "kyc_status IS NULL OR kyc_status = ''",
    "risk": "risk_rating IS NULL",
}


def landed_customer_rules(as_of: datetime) -> dict[str, Rule]:
    today = f"DATE '{as_of:%Y-%m-%d}'"
    upper_cities = CITIES.upper()
    rules = [
        Rule("R3", "customer_id IS NULL OR first_name IS NULL OR last_name IS NULL"),
        Rule("R5", f"kyc_status IS NULL OR upper(trim(kyc_status)) NOT IN ({KYC_STATUSES})"),
        Rule("R6", f"risk_rating NOT BETWEEN {RATINGS}"),
        Rule("R7", f"email NOT LIKE {EMAIL_PATTERN}"),
        Rule("R8", f"upper(trim(city)) NOT IN ({upper_cities})", "warning"),
        Rule("R9", "date_of_birth > created_at"),
        Rule("R10", "date_of_birth > created_at - INTERVAL 18 YEAR"),
        Rule("R11", f"date_of_birth < DATE '1900-01-01' OR date_of_birth > {today}", "warning"),
    ]
    return {rule.name: rule for rule in rules}


def repeated_ids(customers: DataFrame) -> DataFrame:
    return customers.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def repeated_rows(customers: DataFrame) -> DataFrame:
    return customers.groupBy(*customers.columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def null_rates(customers: DataFrame) -> DataFrame:
    rows = F.greatest(F.count(F.lit(1)), F.lit(1))
    return customers.agg(
        *[
            F.round(F.lit(100.0) * F.count_if(F.expr(condition)) / rows, 1).alias(f"{name}_null_pct")
            for name, condition in MONITORED.items()
        ]
    )


def city_spellings(customers: DataFrame, as_of: datetime) -> DataFrame:
    """Rows and spellings outside the known cities, next to all spellings."""
    outside = F.expr(landed_customer_rules(as_of)["R8"].violation)
    per_spelling = customers.groupBy("city").agg(F.count(F.lit(1)).alias("_n"))
    return per_spelling.agg(
        F.coalesce(F.sum(F.when(outside, F.col("_n"))), F.lit(0).cast("bigint")).alias("n_rows"),
        F.count_if(outside).alias("n_cities"),
        F.count("city").alias("n_spellings"),
    )


def unknown_cities(customers: DataFrame, as_of: datetime) -> DataFrame:
    """The spellings outside the known cities, with how many rows hold each."""
    outside = F.expr(landed_customer_rules(as_of)["R8"].violation)
    return customers.filter(outside).groupBy("city").agg(F.count(F.lit(1)).alias("n_rows"))


def shared_emails(customers: DataFrame) -> DataFrame:
    return (
        customers.filter(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.count_distinct("customer_id").alias("n_customers"))
        .filter("n_customers > 1")
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How often each value occurs, blank and missing ones included, for several columns at once."""
    cells = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
                    for c in columns
                ]
            )
        )
    )
    return cells.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n_rows"))


def gate(customers: DataFrame, as_of: datetime) -> DataFrame:
    """Every landed row with the rules it breaks; one blocking rule sends it to quarantine.

    Repeated ids and shared addresses are found by counting, and only those few are joined back.
    """
    rules = landed_customer_rules(as_of)
    repeated = repeated_ids(customers).select(F.col("customer_id").alias("_id"), F.lit(True).alias("_repeated"))
    shared = shared_emails(customers).select(F.col("email").alias("_email"), F.lit(True).alias("_shared"))
    any_missing = " OR ".join(f"({condition})" for condition in MONITORED.values())
    broken = {name: F.expr(rule.violation) for name, rule in rules.items()}
    broken |= {"R1": F.col("_repeated"), "R4": F.expr(any_missing), "R12": F.col("_shared")}

    def listed(names: Sequence[str]) -> Column:
        return F.concat_ws(",", *[F.when(broken[name], name) for name in names])

    flagged = customers.join(repeated, F.col("customer_id").eqNullSafe(F.col("_id")), "left").join(
        shared, F.col("email") == F.col("_email"), "left"
    )
    return flagged.select(
        *[F.col(c) for c in customers.columns],
        listed(GATE_BLOCKING).alias("blocking_rules"),
        listed(GATE_WARNING).alias("warning_rules"),
    ).withColumn("action", F.when(F.col("blocking_rules") == "", "LOAD").otherwise("QUARANTINE"))


# ------------------------------------------------------------------ reconciliation


def conflicting_ids(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one distinct row: copies that disagree, which no clean-up may merge."""
    return df.distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_versions")).filter("n_versions > 1")


def transaction_losses(bronze: DataFrame, accounts: DataFrame, in_time: Column) -> DataFrame:
    """Bronze transactions by what becomes of them; the first cause that applies counts.

    Distinct rows carry their copy counts, and are summed per account before the accounts are
    joined, so neither many copies nor a busy account makes a large group.
    """
    known = keys(accounts, "account_id").select(F.col("account_id").alias("_known"))
    per_account = (
        tally(bronze)
        .groupBy("account_id", F.coalesce(in_time, F.lit(False)).alias("_in_time"))
        .agg(F.count(F.lit(1)).alias("_first"), F.sum(F.col(COPIES) - 1).alias("_later"))
    )
    # The causes, in order of precedence after DUPLICATE.
    fate = (
        F.when(F.col("_known").isNull(), "UNKNOWN_ACCOUNT")
        .when(~F.col("_in_time"), "FUTURE_DATED")
        .otherwise("LOADED")
    )
    parts = F.array(
        F.struct(fate.alias("cause"), F.col("_first").alias("n_rows")),
        F.struct(F.lit("DUPLICATE").alias("cause"), F.col("_later").alias("n_rows")),
    )
    joined = per_account.join(known, F.col("account_id") == F.col("_known"), "left")
    return joined.select(F.inline(parts)).groupBy("cause").agg(F.sum("n_rows").alias("n_rows"))


def row_conservation(bronze: DataFrame, silver: DataFrame, rejected: DataFrame) -> DataFrame:
    """Every landed customer is loaded or rejected, once. The stand-in row was never landed."""
    counted = side_by_side(
        n_bronze=row_count(bronze),
        n_silver=row_count(silver.filter(F.col("customer_id") > 0)),
        n_rejected=row_count(rejected),
    )
    return counted.withColumn("violations", F.abs(F.expr("n_bronze - n_silver - n_rejected")))


def unknown_member_count(silver: DataFrame) -> DataFrame:
    return silver.agg(F.abs(F.lit(1) - F.count_if(F.col("customer_id") == 0)).alias("violations"))
