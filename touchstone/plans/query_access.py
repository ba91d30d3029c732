"""Queries: what each role sees."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchstone.operators import profiling
from touchstone.plans.access import GRANTS, ROLES, Grant, ScopedCatalog, access_from, role_table
from touchstone.plans.lakehouse import OWNERS, TABLES, UNOWNED, Lakehouse
from touchstone.plans.oracles import CTES
from touchstone.plans.query_catalog import _owner_case, profile_oracle, rounded_profile, ROUNDED
from touchstone.plans.registry import over_deployed, over_folder, over_tables
from touchstone.sources.registry import Registry

LONDON = ROLES["branch_ops_london"]

CTES["london_customers"] = "SELECT * FROM silver_customers WHERE city = 'London'"
CTES["london_accounts"] = (
    "SELECT a.* FROM silver_accounts a WHERE EXISTS (FROM london_customers c WHERE c.customer_id = a.customer_id)"
)
CTES["london_transactions"] = (
    "SELECT t.* FROM silver_transactions t WHERE EXISTS (FROM london_accounts a WHERE a.account_id = t.account_id)"
)
CTES["london_customer_360"] = "SELECT * FROM gold_customer_360 WHERE city = 'London'"
CTES["london_customers_rejected"] = "SELECT * FROM silver_customers_rejected WHERE regexp_full_match(city, '(?i) *london *')"
CTES["london_accounts_rejected"] = (
    "SELECT r.* FROM silver_accounts_rejected r WHERE EXISTS (FROM bronze_customers b "
    "WHERE b.customer_id = r.customer_id AND regexp_full_match(b.city, '(?i) *london *'))"
)
SCOPED = {
    "scoped_customers": ("silver_customers", "london_customers"),
    "scoped_accounts": ("silver_accounts", "london_accounts"),
    "scoped_transactions": ("silver_transactions", "london_transactions"),
    "scoped_customer_360": ("gold_customer_360", "london_customer_360"),
    "scoped_customers_rejected": ("silver_customers_rejected", "london_customers_rejected"),
    "scoped_accounts_rejected": ("silver_accounts_rejected", "london_accounts_rejected"),
}

for _key, (_table, _cte) in SCOPED.items():
    over_tables(_key, f"SELECT * FROM {_cte}")(
        lambda lake, t=_table: ScopedCatalog(lake, LONDON).table(t).drop("rejected_at")
    )


@over_tables(
    "scoped_aggregate",
    "SELECT c.kyc_status, count(DISTINCT c.customer_id) AS n_customers, count(a.account_id) AS n_accounts, "
    "round(sum(a.balance), 2) AS total_balance FROM london_customers c "
    "LEFT JOIN london_accounts a ON a.customer_id = c.customer_id GROUP BY c.kyc_status",
)
def _scoped_aggregate(lake: Lakehouse) -> DataFrame:
    """Accounts are summed per customer before the join, so a busy customer is one row in it."""
    scoped = ScopedCatalog(lake, LONDON)
    held = scoped.table("silver_accounts").groupBy("customer_id").agg(
        F.count("account_id").alias("n"), F.sum("balance").alias("held")
    )
    return (
        scoped.table("silver_customers")
        .join(held, "customer_id", "left")
        .groupBy("kyc_status")
        .agg(
            F.count("customer_id").alias("n_customers"),
            F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n_accounts"),
            F.round(F.sum("held"), 2).alias("total_balance"),
        )
    )


STATEMENT = (
    "SELECT account_type, status, count(*) AS n_accounts, min(opened_date) AS first_opened "
    "FROM silver_accounts a JOIN silver_customers AS c ON a.customer_id = c.customer_id "
    "WHERE c.risk_rating > 1 GROUP BY account_type, status"
)

over_tables(
    "scoped_query",
    "SELECT account_type, status, count(*) AS n_accounts, min(opened_date) AS first_opened FROM london_accounts "
    "JOIN london_customers USING (customer_id) WHERE risk_rating >= 2 GROUP BY ALL",
)(lambda lake: ScopedCatalog(lake, LONDON).query(STATEMENT))

over_tables("scoped_profile", f"SELECT {ROUNDED} FROM ({profile_oracle('silver_customers', True, 'london_customers')})")(
    lambda lake: rounded_profile(ScopedCatalog(lake, LONDON).profile("silver_customers"))
)


def _listing_oracle() -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS n_rows FROM {cte}" for table, cte in SCOPED.values()
    )
    return f"SELECT table_name, split_part(table_name, '_', 1) AS layer, {_owner_case()} AS owner, n_rows FROM ({counts})"


@over_deployed("scoped_table_list", _listing_oracle())
def _listing(lake: Lakehouse) -> DataFrame:
    return ScopedCatalog(lake, LONDON).listing(OWNERS, UNOWNED)


@over_deployed(
    "role_visible_tables",
    " UNION ALL ".join(
        f"SELECT '{role}' AS role, '{t}' AS table_name, '{o}' AS owner, (SELECT count(*) FROM {c}) AS n_rows"
        for role, shown in {
            "analyst": {t: t for t in TABLES},
            "dq_auditor": {t: t for t in TABLES},
            "branch_ops_london": dict(SCOPED.values()),
        }.items()
        for t, c in shown.items()
        for o in [OWNERS[t.partition("_")[2]]]
    ),
)
def _visible(lake: Lakehouse) -> DataFrame:
    """Roles without row filters see the same counts, so those are taken once."""
    unfiltered = ScopedCatalog(lake, ROLES["analyst"]).listing(OWNERS, UNOWNED)
    everything = unfiltered.select(
        F.explode(F.array(F.lit("analyst"), F.lit("dq_auditor"))).alias("role"), "table_name", "owner", "n_rows"
    )
    london = ScopedCatalog(lake, LONDON).listing(OWNERS, UNOWNED)
    return everything.unionByName(london.select(F.lit(LONDON.role).alias("role"), "table_name", "owner", "n_rows"))


CTES["leeds_customers"] = "SELECT * FROM silver_customers WHERE city = 'Leeds'"
LEEDS = [
    Grant("branch_ops_leeds", "silver_customers", "city = 'Leeds'"),
    Grant("branch_ops_leeds", "silver_accounts", "city = 'Leeds'", (("customer_id", "silver_customers"),)),
    Grant("branch_ops_leeds", "gold_monthly_channel_volume"),
]


@over_tables(
    "role_table_access",
    "SELECT 'silver_customers' AS table_name, 'customers' AS subject, (SELECT count(*) FROM leeds_customers) AS n_rows UNION ALL "
    "SELECT 'silver_accounts', 'accounts', (SELECT count(*) FROM silver_accounts SEMI JOIN leeds_customers USING (customer_id)) UNION ALL "
    "SELECT 'gold_monthly_channel_volume', 'monthly_channel_volume', (SELECT count(*) FROM gold_monthly_channel_volume)",
)
def _by_role_table(lake: Lakehouse) -> DataFrame:
    """A role that only rows of the role table know."""
    table = role_table(lake.spark, [*GRANTS, *LEEDS])
    listing = ScopedCatalog(lake, access_from(table, "branch_ops_leeds")).listing(OWNERS, UNOWNED)
    return listing.select("table_name", F.expr("substring(table_name, instr(table_name, '_') + 1)").alias("subject"), "n_rows")


def _personal_oracle(role: str, masked: bool, relation: str) -> str:
    return (
        f"SELECT '{role}' AS role, column_name, min_text, max_text, samples FROM "
        f"({profile_oracle('silver_customers', masked, relation)}) WHERE is_personal"
    )


@over_tables(
    "masked_profile_by_role",
    " UNION ALL ".join(
        [
            _personal_oracle("analyst", True, "silver_customers"),
            _personal_oracle("dq_auditor", False, "silver_customers"),
            _personal_oracle("branch_ops_london", True, "london_customers"),
        ]
    ),
)
def _masked_by_role(lake: Lakehouse) -> DataFrame:
    def seen(role: str) -> DataFrame:
        shown = ScopedCatalog(lake, ROLES[role]).profile("silver_customers", profiling.PERSONAL)
        return shown.select(
            F.lit(role).alias("role"), "column_name", "min_text", "max_text", F.concat_ws(", ", "samples").alias("samples")
        )

    return reduce(DataFrame.unionByName, [seen(role) for role in ROLES])


# The contracts of the registry belong to tables in turn.
REGISTRY_TABLES = (
    "CASE CAST(replace(contract_id, 'ds_', '') AS BIGINT) % 5 WHEN 0 THEN 'silver_customers' WHEN 1 THEN 'bronze_customers' "
    "WHEN 2 THEN 'gold_customer_360' WHEN 3 THEN 'bronze_accounts' ELSE 'silver_transactions' END"
)


@over_folder(
    "scoped_contracts",
    f"SELECT * FROM (SELECT *, {REGISTRY_TABLES} AS table_name FROM old_columns) WHERE table_name IN "
    "('silver_customers', 'gold_customer_360', 'silver_transactions')",
)
def _scoped_contracts(spark: SparkSession, folder: str) -> DataFrame:
    columns = Registry(spark, folder).old_columns.selectExpr("*", f"{REGISTRY_TABLES} AS table_name")
    catalog = ScopedCatalog(Lakehouse.over_test_tables(spark, folder), LONDON)
    return catalog.contract_columns(columns, "table_name")
