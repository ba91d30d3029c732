"""Queries: scans, models, joins, set operations, windows, aggregates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.functions import text
from touchstone.functions.dates import latest_adult_birth, month_of
from touchstone.operators import copies, keyed, quality
from touchstone.plans import medallion
from touchstone.plans.lakehouse import LINEAGE, TABLES, Lakehouse, conservation, deploy, models_folder
from touchstone.plans.registry import over_deployed, over_folder, over_tables
from touchstone.session import drop_at_exit, scratch_path
from touchstone.sources import store, tables
from touchstone.sources.derived import select_items, select_list, source_table

for _name in LINEAGE:
    # The rejection time is the moment of the run, not a result.
    over_tables(_name, f"SELECT * FROM {_name}")(lambda lake, n=_name: lake[n].drop("rejected_at"))

over_tables("scan_bronze_customers", "SELECT * FROM bronze_customers")(lambda lake: lake["bronze_customers"])

over_tables("evolve_customers", "SELECT * FROM evolved_customers")(
    lambda lake: medallion.evolve_customers(lake["silver_customers"])
)


@over_tables("write_full_refresh", "SELECT * FROM silver_accounts")
def _written_accounts(lake: Lakehouse) -> DataFrame:
    """Two refreshes of one table, the second of which is read."""
    folder = scratch_path(lake.spark, "refresh")
    drop_at_exit(lake.spark, folder)
    tables.write_full_refresh(lake["silver_accounts"].limit(0), folder, "silver_accounts")
    tables.write_full_refresh(lake["silver_accounts"], folder, "silver_accounts")
    return tables.read_current(lake.spark, folder, "silver_accounts")


@over_folder(
    "build_lakehouse",
    "SELECT 'customers' AS balance, CAST((SELECT count(*) FROM bronze_customers) AS DOUBLE) AS expected, "
    "CAST((SELECT count(*) FROM silver_customers WHERE customer_id > 0) + (SELECT count(*) FROM silver_customers_rejected) AS DOUBLE) "
    "AS found, true AS balanced UNION ALL SELECT 'accounts', (SELECT count(*) FROM bronze_accounts), "
    "(SELECT count(*) FROM silver_accounts), true UNION ALL SELECT 'balances', (SELECT round(sum(balance), 2) FROM silver_accounts), "
    "(SELECT round(sum(total_balance), 2) FROM gold_customer_360), true UNION ALL SELECT 'rejected ' || reason_code, count(*), count(*), "
    "true FROM silver_accounts_rejected GROUP BY reason_code",
)
def _build(spark: SparkSession, folder: str) -> DataFrame:
    """Builds all models; what their writes counted is the result. Catalog queries read the build from then on."""
    deploy(spark, folder)
    build = store.latest(spark, models_folder(spark, folder))
    rows = [(name, round(float(a), 2), round(float(b), 2), ok) for name, a, b, ok in conservation(build.tables, build.measures)]
    for reason, key in (("ORPHAN_CUSTOMER", "orphan_accounts"), ("CUSTOMER_REJECTED_UPSTREAM", "upstream_accounts")):
        n = float(build.measures[key])
        rows += [(f"rejected {reason}", n, n, True)] if n else []
    return spark.createDataFrame(rows, "balance STRING, expected DOUBLE, found DOUBLE, balanced BOOLEAN")


MONTH = "1996-03"


@over_folder("transactions_of_month", f"SELECT * FROM silver_transactions WHERE strftime(txn_ts, '%Y-%m') = '{MONTH}'")
def _of_month(spark: SparkSession, folder: str) -> DataFrame:
    return Lakehouse.deployed(spark, folder).month("silver_transactions", MONTH)


@over_deployed(
    "table_row_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in TABLES),
)
def _row_counts(lake: Lakehouse) -> DataFrame:
    return lake.row_counts()


@over_tables(
    "bounded_query",
    "SELECT account_id, customer_id, balance, (SELECT count(*) FROM silver_accounts WHERE balance > 1000) > 200 "
    "AS truncated FROM silver_accounts WHERE balance > 1000 ORDER BY balance DESC, account_id LIMIT 200",
)
def _bounded(lake: Lakehouse) -> DataFrame:
    rich = lake["silver_accounts"].filter("balance > 1000").select("account_id", "customer_id", "balance")
    return keyed.bounded(rich, [F.desc("balance"), F.asc("account_id")], 200)


# ------------------------------------------------------------------ joins and set operations


@over_tables(
    "join_left_anti",
    "SELECT a.* FROM bronze_accounts a LEFT JOIN (SELECT DISTINCT customer_id AS known FROM silver_customers) "
    "ON customer_id = known WHERE known IS NULL",
)
def _left_anti(lake: Lakehouse) -> DataFrame:
    return keyed.without(lake["bronze_accounts"], lake["silver_customers"], "customer_id")


@over_tables(
    "join_left_semi",
    "SELECT * FROM bronze_transactions WHERE account_id IN (SELECT account_id FROM bronze_accounts)",
)
def _left_semi(lake: Lakehouse) -> DataFrame:
    return keyed.within(lake["bronze_transactions"], lake["bronze_accounts"], "account_id")


@over_tables(
    "join_anti_equivalence",
    "SELECT count(*) AS n_anti, count(*) AS n_outer, true AS equal FROM bronze_accounts "
    "WHERE customer_id NOT IN (SELECT customer_id FROM silver_customers)",
)
def _anti_equivalence(lake: Lakehouse) -> DataFrame:
    accounts, customers = lake["bronze_accounts"], lake["silver_customers"]
    return quality.side_by_side(
        n_anti=quality.row_count(keyed.without(accounts, customers, "customer_id")),
        n_outer=quality.row_count(keyed.without_by_outer_join(accounts, customers, "customer_id")),
    ).withColumn("equal", F.col("n_anti") == F.col("n_outer"))


@over_tables(
    "dropped_customers",
    "SELECT DISTINCT b.* FROM bronze_customers b WHERE NOT EXISTS "
    "(SELECT 1 FROM silver_customers s WHERE s.customer_id = b.customer_id)",
)
def _dropped(lake: Lakehouse) -> DataFrame:
    return keyed.without(lake["bronze_customers"].distinct(), lake["silver_customers"], "customer_id")


@over_tables(
    "set_except_ids",
    "SELECT customer_id FROM bronze_customers EXCEPT SELECT customer_id FROM silver_customers",
)
def _except_ids(lake: Lakehouse) -> DataFrame:
    return keyed.ids_only_in(lake["bronze_customers"], lake["silver_customers"], "customer_id")


@over_tables(
    "set_intersect_ids",
    "SELECT customer_id FROM bronze_customers INTERSECT SELECT customer_id FROM silver_customers",
)
def _intersect_ids(lake: Lakehouse) -> DataFrame:
    return keyed.ids_in_both(lake["bronze_customers"], lake["silver_customers"], "customer_id")


@over_tables("distinct_rows", "SELECT DISTINCT * FROM bronze_transactions")
def _distinct_rows(lake: Lakehouse) -> DataFrame:
    return lake["bronze_transactions"].distinct()


@over_tables(
    "fanout_check",
    "SELECT a.customer_id, round(any_value(r.right_total), 2) AS right_total, "
    "round(sum(a.balance), 2) AS fanned_out_total "
    "FROM silver_accounts a LEFT JOIN silver_transactions t ON t.account_id = a.account_id "
    "JOIN (SELECT customer_id, sum(balance) AS right_total FROM silver_accounts GROUP BY customer_id) r "
    "ON r.customer_id = a.customer_id GROUP BY a.customer_id",
)
def _fanout(lake: Lakehouse) -> DataFrame:
    return medallion.fanout_check(lake["silver_accounts"], lake.conformed_transactions)


# ------------------------------------------------------------------ windows and aggregates


@over_tables(
    "window_row_number_dups",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, account_id, amount, currency, txn_ts, "
    "channel, merchant_category_code) AS copy_number FROM bronze_transactions) WHERE copy_number > 1",
)
def _later_copies(lake: Lakehouse) -> DataFrame:
    return copies.number_copies(copies.tally(lake["bronze_transactions"]), first=2)


@over_tables(
    "window_identity_dups",
    "SELECT customer_id, first_name, last_name, date_of_birth, n_same FROM (SELECT *, count(*) OVER "
    "(PARTITION BY first_name, last_name, date_of_birth) AS n_same FROM bronze_customers) WHERE n_same > 1",
)
def _identity_dups(lake: Lakehouse) -> DataFrame:
    columns = ["first_name", "last_name", "date_of_birth"]
    return copies.with_group_size(lake["bronze_customers"].select("customer_id", *columns), columns, "n_same")


@over_tables(
    "window_keep_first",
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY created_at NULLS LAST, "
    "first_name, last_name, email, date_of_birth, city, kyc_status, risk_rating) AS rn FROM bronze_customers) "
    "WHERE rn = 1",
)
def _keep_first(lake: Lakehouse) -> DataFrame:
    ties = ["first_name", "last_name", "email", "date_of_birth", "city", "kyc_status", "risk_rating"]
    order = [F.asc_nulls_last(c) for c in ["created_at", *ties]]
    return copies.first_per_key(lake["bronze_customers"], "customer_id", *order)


@over_tables(
    "agg_count_distinct",
    "SELECT customer_id, (SELECT count(*) FROM (SELECT DISTINCT account_id FROM silver_accounts i "
    "WHERE i.customer_id = o.customer_id)) AS n_accounts FROM silver_accounts o GROUP BY customer_id",
)
def _count_distinct(lake: Lakehouse) -> DataFrame:
    return lake["silver_accounts"].groupBy("customer_id").agg(F.count_distinct("account_id").alias("n_accounts"))


@over_tables(
    "agg_group_by_all",
    "SELECT account_type, status, count(*) AS n_accounts, round(sum(balance), 2) AS total_balance, "
    "min(opened_date) AS first_opened FROM silver_accounts GROUP BY ALL",
)
def _group_by_all(lake: Lakehouse) -> DataFrame:
    return lake.spark.sql(
        "SELECT account_type, status, count(*) AS n_accounts, round(sum(balance), 2) AS total_balance, "
        "min(opened_date) AS first_opened FROM {accounts} GROUP BY ALL",
        accounts=lake["silver_accounts"],
    )


# ------------------------------------------------------------------ scalar functions


@over_tables(
    "scalar_text_functions",
    "SELECT customer_id, upper(left(trim(last_name), 1)) || lower(trim(last_name)[2:]) AS name, "
    "CASE WHEN email LIKE '%@%.%' THEN lower(email) END AS email, upper(nullif(trim(kyc_status), '')) AS status, "
    "nullif(risk_rating, 99) AS rating, coalesce(trim(city), 'n/a') AS city, "
    "CASE WHEN email IS NULL THEN NULL WHEN position('@' IN email) > 0 THEN left(split_part(email, '@', 1), 1) "
    "|| '***@' || email[position('@' IN email) + 1:] WHEN length(email) <= 1 THEN '*' "
    "ELSE left(email, 1) || repeat('*', length(email) - 1) END AS hidden FROM bronze_customers",
)
def _text_functions(lake: Lakehouse) -> DataFrame:
    return lake["bronze_customers"].select(
        "customer_id",
        text.capitalised(F.col("last_name")).alias("name"),
        text.plausible_email(F.col("email")).alias("email"),
        text.code(F.col("kyc_status")).alias("status"),
        F.nullif("risk_rating", F.lit(medallion.NOT_SCORED)).alias("rating"),
        F.coalesce(F.trim("city"), F.lit("n/a")).alias("city"),
        text.masked(F.col("email")).alias("hidden"),
    )


@over_tables(
    "scalar_date_functions",
    "SELECT DISTINCT opened_date, CAST(date_trunc('month', CAST(opened_date AS TIMESTAMP)) AS TIMESTAMP) AS month, "
    "CAST(opened_date - INTERVAL 18 YEAR AS DATE) AS adult_if_born_by, opened_date < DATE '2000-01-01' AS last_century, "
    "CAST(opened_date AS TIMESTAMP) AS opened_ts FROM bronze_accounts",
)
def _date_functions(lake: Lakehouse) -> DataFrame:
    day = F.col("opened_date")
    return (
        lake["bronze_accounts"]
        .select("opened_date")
        .distinct()
        .select(
            day,
            month_of(day.cast("timestamp_ntz")).alias("month"),
            latest_adult_birth(day).alias("adult_if_born_by"),
            (day < F.to_date(F.lit("2000-01-01"))).alias("last_century"),
            day.cast("timestamp_ntz").alias("opened_ts"),
        )
    )


# A moment as ISO text, and no NaN in JSON.
@over_tables(
    "json_safe_rows",
    "SELECT txn_id, account_id, CAST(json_object('txn_id', txn_id, 'amount', CASE WHEN txn_id % 101 <> 0 THEN amount END, "
    "'txn_ts', strftime(txn_ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN part > 0 THEN '.' || lpad(CAST(part AS VARCHAR), 6, '0') ELSE '' END, 'channel', channel) AS VARCHAR) AS document "
    "FROM (SELECT * REPLACE (txn_ts + to_microseconds(txn_id % 7 * 104729) AS txn_ts), txn_id % 7 * 104729 AS part "
    "FROM silver_transactions)",
)
def _json_rows(lake: Lakehouse) -> DataFrame:
    measured = lake["silver_transactions"].withColumns(
        {
            "amount": F.when(F.col("txn_id") % 101 == 0, F.lit(float("nan"))).otherwise(F.col("amount")),
            "txn_ts": F.expr("txn_ts + make_dt_interval(0, 0, 0, (txn_id % 7 * 104729) / 1000000BD)"),
        }
    )
    return measured.select(
        "txn_id",
        "account_id",
        text.json_document(measured.select("txn_id", "amount", "txn_ts", "channel").schema).alias("document"),
    )


# A log of statements, one per order, that name the tables in several ways.
QUERY_LOG = {
    "query_id": "o_orderkey",
    "query_text": (
        "CASE o_orderkey % 5 "
        "WHEN 0 THEN 'SELECT * FROM silver_customers WHERE customer_id = ' || CAST(o_custkey AS STRING) "
        "WHEN 1 THEN 'select count(*) from SILVER_ACCOUNTS a join silver_customers c using (customer_id)' "
        "WHEN 2 THEN 'SELECT * FROM silver_customers_rejected' "
        "WHEN 3 THEN 'SELECT city FROM gold_customer_360, silver_transactions_archive' "
        "ELSE 'SELECT ' || CAST(o_custkey AS STRING) END"
    ),
}


@over_folder(
    "query_table_refs",
    " UNION ALL ".join(
        f"SELECT query_id, '{name}' AS table_name FROM (SELECT {select_list(QUERY_LOG)} FROM orders) "
        f"WHERE regexp_matches(query_text, '(?i)\\b{name}\\b')"
        for name in TABLES
    ),
)
def _table_refs(spark: SparkSession, folder: str) -> DataFrame:
    log = source_table(spark, folder, "bronze_accounts").selectExpr(*select_items(QUERY_LOG))
    return text.table_references(log, "query_text", TABLES).select("query_id", "table_name")
