from __future__ import annotations

import json
from datetime import date

import pytest

from touchstone.plans.access import (
    GRANTS,
    ROLE_SETTING,
    ROLES,
    AccessError,
    Grant,
    QueryError,
    ScopedCatalog,
    access_from,
    current_role,
    role_table,
)
from touchstone.operators.contract_diff import IGNORED_PARTS
from touchstone.plans.lakehouse import OWNERS, TABLES, UNOWNED, Lakehouse

LONDON = ROLES["branch_ops_london"]


@pytest.fixture(scope="module")
def lake(spark, folder):
    lake = Lakehouse.over_test_tables(spark, folder)
    lake.materialise()
    return lake


@pytest.fixture
def london(lake):
    return ScopedCatalog(lake, LONDON)


def test_roles(spark):
    assert ROLES["analyst"].to("bronze_customers") and not ROLES["analyst"].reveals
    assert ROLES["dq_auditor"].to("bronze_customers") and ROLES["dq_auditor"].reveals
    assert LONDON.to("silver_customers_rejected") and "bronze_customers" not in LONDON.grants
    table = role_table(spark).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in table} == {name: len(access.grants) for name, access in ROLES.items()}


def test_denied_tables_are_named_in_order():
    with pytest.raises(AccessError, match="bronze_accounts, bronze_customers$"):
        LONDON.to("silver_customers", "bronze_customers", "bronze_accounts")
    assert len(LONDON.to("silver_customers", "gold_customer_360")) == 2


def test_role_of_the_session(spark):
    assert current_role(spark).role == "analyst"
    spark.conf.set(ROLE_SETTING, "dq_auditor")
    assert current_role(spark).role == "dq_auditor"
    spark.conf.set(ROLE_SETTING, "nope")
    with pytest.raises(AccessError, match="known roles: analyst, branch_ops_london, dq_auditor"):
        current_role(spark)
    spark.conf.unset(ROLE_SETTING)


def test_scoped_rows(lake, london):
    counts = {r["table_name"]: r["n_rows"] for r in london.listing(OWNERS, UNOWNED).collect()}
    assert counts["silver_customers"] == 46 and counts["silver_accounts"] == 479
    assert counts["silver_transactions"] == 1879 and set(counts) == set(LONDON.grants)
    assert counts["silver_accounts_rejected"] > 0  # would be none by way of silver customers
    with pytest.raises(AccessError):
        london.table("bronze_customers")
    everything = ScopedCatalog(lake, ROLES["analyst"])
    assert everything.names == TABLES and everything.table("silver_customers").count() == 140


def test_rows_are_filtered_before_a_callers_aggregate(london):
    rows = london.query("SELECT city, count(*) AS n FROM silver_customers GROUP BY city;").collect()
    assert [tuple(r) for r in rows] == [("London", 46)]


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT count(*) FROM silver_customers",
        "SELECT count(*) FROM silver_customers c",
        "SELECT count(*) FROM silver_customers AS c",
        "SELECT count(*) FROM `silver_customers` -- all of them",
        "select COUNT(*) from SILVER_CUSTOMERS",
        "WITH c AS (SELECT * FROM silver_customers) SELECT count(*) FROM c",
        "SELECT count(*) FROM (SELECT customer_id FROM silver_customers) x",
    ],
)
def test_no_phrasing_reaches_other_rows(london, statement):
    assert london.query(statement).first()[0] == 46


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT 1; SELECT 2",
        "DROP VIEW silver_customers",
        "CREATE TABLE x AS SELECT 1",
        "SET spark.sql.runSQLOnFiles=true",
        "INSERT INTO silver_customers SELECT * FROM silver_customers",
        "SELECT * FROM no_such_table",
        "SELECT 1) AS a; DROP VIEW silver_customers; SELECT * FROM (SELECT 1",
    ],
)
def test_only_queries_run(london, statement):
    with pytest.raises(QueryError):
        london.query(statement)


def test_out_of_scope_data_cannot_be_named(spark, folder, london, tmp_path):
    with pytest.raises(AccessError):
        london.query("SELECT * FROM bronze_customers")
    with pytest.raises(QueryError):
        london.query(f"SELECT * FROM parquet.`{folder}/customer.parquet`")
    spark.range(3).createOrReplaceTempView("someone_elses_view")
    with pytest.raises(QueryError):
        london.query("SELECT * FROM someone_elses_view")


def test_saved_tables_are_out_of_scope(spark, london, tmp_path):
    spark.range(3).write.mode("overwrite").option("path", str(tmp_path / "saved")).saveAsTable("saved_numbers")
    try:
        for place in ("saved_numbers", "default.saved_numbers", "spark_catalog.default.saved_numbers"):
            with pytest.raises(AccessError, match="saved tables"):
                london.query(f"SELECT * FROM {place}")
        with pytest.raises(AccessError, match="saved tables"):
            london.query("SELECT * FROM silver_customers WHERE customer_id IN (SELECT id FROM saved_numbers)")
    finally:
        spark.sql("DROP TABLE saved_numbers")


def test_global_views_and_foreign_code_are_out_of_scope(spark, london):
    spark.range(3).createOrReplaceGlobalTempView("everyone")
    try:
        for statement in (
            "SELECT count(*) FROM global_temp.everyone",
            "SELECT (SELECT count(*) FROM global_temp.everyone) AS n FROM silver_customers",
            "WITH e AS (SELECT * FROM global_temp.everyone) SELECT * FROM e",
        ):
            with pytest.raises(AccessError, match="everyone"):
                london.query(statement)
    finally:
        spark.catalog.dropGlobalTempView("everyone")
    for call in ("java_method", "reflect", "try_reflect"):
        with pytest.raises(AccessError, match="JVM"):
            london.query(f"SELECT upper({call}('java.lang.System', 'getProperty', 'user.name')) FROM silver_customers")
    assert london.query("SELECT 'spark_catalog.x' AS name").first()[0] == "spark_catalog.x"
    made = london.query("SELECT * FROM VALUES (1), (2) AS t(a) UNION ALL SELECT id FROM range(3)")
    assert made.count() == 5


def test_inspection_statements(london):
    columns = london.query("DESCRIBE silver_customers").collect()
    assert columns == london.describe("silver_customers").collect() and columns[0]["n_values"] == 46
    assert "London" in london.query("EXPLAIN SELECT * FROM silver_customers").first()[0]
    with pytest.raises(AccessError):
        london.query("DESC TABLE bronze_customers;")
    with pytest.raises(AccessError):
        london.query("EXPLAIN SELECT * FROM bronze_customers")


def test_explain_shows_the_row_filter(london):
    assert "London" in london.explain("SELECT count(*) FROM silver_customers")
    with pytest.raises(QueryError):
        london.explain("DROP VIEW silver_customers")


def test_fetch_is_capped_and_says_so(london):
    exact = london.fetch("SELECT account_id FROM silver_accounts ORDER BY account_id LIMIT 200")
    assert len(exact["rows"]) == 200 and exact["truncated"] is False
    more = london.fetch("SELECT account_id, opened_date FROM silver_accounts ORDER BY account_id LIMIT 201")
    assert len(more["rows"]) == 200 and more["truncated"] is True
    assert more["columns"] == ["account_id", "opened_date"]
    first = json.loads(more["rows"][0])
    assert date.fromisoformat(first["opened_date"]) and first["account_id"] > 0


def test_masks_follow_the_role(lake, london):
    def first_email(catalog):
        rows = catalog.profile("silver_customers", ["email"]).first()
        return rows["samples"][0]

    assert first_email(ScopedCatalog(lake, ROLES["dq_auditor"])) == "c100@example.com"
    assert first_email(ScopedCatalog(lake, ROLES["analyst"])) == "c***@example.com"
    assert first_email(london) == "c***@example.com"
    plain, hidden = london.table("silver_customers"), london.table("silver_customers", masked=True)
    assert "***@" in hidden.filter("email IS NOT NULL").first()["email"]
    assert "***@" not in plain.filter("email IS NOT NULL").first()["email"]


def test_filter_reaches_the_scan(spark, tmp_path, capsys):
    """Over landed files the row filter of a scoped table is pushed into the parquet reader."""
    rows = spark.range(10).selectExpr("id AS customer_id", "CASE WHEN id % 2 = 0 THEN 'London' ELSE 'Leeds' END AS city")
    rows.write.parquet(str(tmp_path / "c"))
    lake = Lakehouse(spark, lambda session, name: None)
    lake.replace("silver_customers", spark.read.parquet(str(tmp_path / "c")))
    ScopedCatalog(lake, LONDON).table("silver_customers").groupBy().count().explain()
    assert "PushedFilters: [IsNotNull(city), EqualTo(city,London)]" in capsys.readouterr().out


def test_filter_through_accounts_is_one_join_for_transactions(spark, folder, capsys):
    unwritten = Lakehouse.over_test_tables(spark, folder)
    scoped = ScopedCatalog(unwritten, LONDON).table("silver_transactions")
    scoped.explain()
    assert capsys.readouterr().out.count("LeftSemi") == 2  # transactions to accounts, accounts to customers
    assert scoped.count() == 1879
    kept = unwritten["silver_transactions"].limit(5)
    unwritten.replace("silver_transactions", kept)
    assert ScopedCatalog(unwritten, ROLES["analyst"]).table("silver_transactions").count() == 5
    assert ScopedCatalog(unwritten, LONDON).table("silver_transactions").count() <= 5


def test_describe_and_contracts(spark, london):
    listing = {r["column_name"]: (r["data_type"], r["n_values"]) for r in london.describe("silver_customers").collect()}
    assert listing["customer_id"] == ("BIGINT", 46)
    columns = spark.createDataFrame([("bronze_customers", "a"), ("silver_customers", "b")], "contract_id STRING, name STRING")
    assert [r["name"] for r in london.contract_columns(columns).collect()] == ["b"]
    assert "profile_expectations" in IGNORED_PARTS


def test_role_table_governs(spark, lake):
    """A row more in the table, and the role sees a table more; nothing else changes."""
    rows = [*GRANTS, Grant("branch_ops_leeds", "silver_customers", "city = 'Leeds'")]
    scoped = ScopedCatalog(lake, access_from(role_table(spark, rows), "branch_ops_leeds"))
    seen = lake["silver_customers"].filter("city = 'Leeds'").count()
    assert scoped.names == ["silver_customers"] and scoped.query("SELECT count(*) AS n FROM silver_customers").first()["n"] == seen
    with pytest.raises(AccessError, match="may not read silver_accounts"):
        scoped.table("silver_accounts")
    more = Grant("branch_ops_leeds", "silver_accounts", "city = 'Leeds'", (("customer_id", "silver_customers"),))
    wider = ScopedCatalog(lake, access_from(role_table(spark, [*rows, more]), "branch_ops_leeds"))
    assert wider.names == ["silver_accounts", "silver_customers"] and 0 < wider.table("silver_accounts").count()
    assert access_from(role_table(spark), "dq_auditor").reveals and not scoped.role.reveals
    with pytest.raises(AccessError, match="known roles: analyst"):
        access_from(role_table(spark), "branch_ops_leeds")
