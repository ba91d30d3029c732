"""Models on the test tables at a larger scale, and on rows made to break them."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from touchstone.operators import copies, quality
from touchstone.plans import medallion
from touchstone.plans.lakehouse import LINEAGE, Lakehouse
from touchstone.sources.tables import BRONZE_SCHEMAS

NOW = datetime(2024, 6, 1)


def customers(spark, rows):
    return spark.createDataFrame(rows, BRONZE_SCHEMAS["bronze_customers"])


def customer(number, birth=date(1980, 1, 1), onboarded=date(2020, 1, 1), **changes):
    row = {
        "customer_id": number, "first_name": "ann", "last_name": "lee", "email": "Ann@X.com", "date_of_birth": birth,
        "city": " leeds ", "kyc_status": " verified", "risk_rating": 2, "created_at": onboarded,
    }
    return tuple((row | changes).values())


def accounts(spark, rows):
    return spark.createDataFrame(rows, BRONZE_SCHEMAS["bronze_accounts"])


def account(number, owner, balance=10.0, kind="CUR", status=" open"):
    return (number, owner, kind, balance, "GBP", date(2020, 1, 1), status)


# Counts worked out beforehand for the projected bronze tables.
EXPECTED = {
    "bronze_customers": 1567,
    "bronze_accounts": 15000,
    "bronze_transactions": 60287,
    "silver_customers": 1375,
    "silver_customers_rejected": 193,
    "silver_accounts": 15000,
    "silver_accounts_rejected": 1288,
    "silver_transactions": 58171,
    "gold_customer_360": 1375,
    "gold_monthly_channel_volume": 415,
}


def test_counts_at_a_larger_scale(spark):
    lake = Lakehouse.over_test_tables(spark, "/root/testdata/sf0.01")
    lake.materialise()
    assert {name: lake[name].count() for name in EXPECTED} == EXPECTED
    reasons = lake["silver_customers_rejected"].groupBy("reason_code").count()
    assert {r["reason_code"]: r["count"] for r in reasons.collect()} == {
        "DUPLICATE_ROW": 67,
        "DOB_IMPLAUSIBLE": 22,
        "DOB_AFTER_ONBOARDING": 15,
        "MINOR_AT_ONBOARDING": 62,
        "UNKNOWN": 27,
    }
    unknown = lake["gold_customer_360"].filter("customer_id = 0").first()
    assert (unknown["n_accounts"], unknown["total_balance"], unknown["n_txns"]) == (1288, 695647543.64, 5119)


def test_clean_customer(spark):
    silver = medallion.silver_customers(customers(spark, [customer(7, risk_rating=99, kyc_status="  ")]))
    row = silver.filter("customer_id = 7").first()
    assert (row["first_name"], row["city"], row["email"]) == ("Ann", "Leeds", "ann@x.com")
    assert row["kyc_status"] is None and row["risk_rating"] is None


def test_empty_input_still_has_the_unknown_member(spark):
    silver = medallion.silver_customers(customers(spark, []))
    assert [r["customer_id"] for r in silver.collect()] == [0]
    assert quality.violations(customers(spark, []), [quality.CUSTOMER_RULES["known_city"]]).first()["rows_checked"] == 0


@pytest.mark.parametrize(
    ("birth", "onboarded", "accepted"),
    [
        (date(2004, 2, 29), date(2022, 2, 27), False),
        (date(2004, 2, 28), date(2022, 2, 28), True),  # exactly eighteen
        (date(2004, 2, 29), date(2022, 2, 28), False),
        (date(2004, 2, 29), date(2022, 3, 1), True),
        (date(2004, 2, 28), date(2024, 2, 29), True),
        (date(1910, 1, 1), date(2022, 1, 1), True),
        (date(1909, 12, 31), date(2022, 1, 1), False),
        (None, date(2022, 1, 1), True),
        (None, None, True),
        (date(1980, 1, 1), None, False),
    ],
)
def test_birth_rule(spark, birth, onboarded, accepted):
    silver = medallion.silver_customers(customers(spark, [customer(1, birth, onboarded)]))
    assert (silver.filter("customer_id = 1").count() == 1) == accepted


def quarantined(spark, rows):
    bronze = customers(spark, rows)
    silver = medallion.silver_customers(bronze)
    rejected = medallion.silver_customers_rejected(bronze, silver, NOW)
    outcome = quality.row_conservation(bronze, silver, rejected).first()
    return sorted((r["customer_id"], r["reason_code"]) for r in rejected.collect()), outcome["violations"]


def test_conflicting_rows_hide_a_rejected_one_and_the_check_shows_it(spark):
    minor = customer(1, date(2015, 1, 1))
    reasons, violations = quarantined(spark, [customer(1), minor])
    assert reasons == [] and violations == 1
    conflicts = quality.conflicting_ids(customers(spark, [customer(1), customer(1), minor, customer(2)]), "customer_id")
    assert [tuple(r) for r in conflicts.collect()] == [(1, 2)]


def test_all_copies_but_one_are_rejected(spark):
    reasons, violations = quarantined(spark, [customer(1)] * 3 + [customer(2, date(2015, 1, 1))] * 2)
    assert reasons == [(1, "DUPLICATE_ROW")] * 2 + [(2, "DUPLICATE_ROW"), (2, "MINOR_AT_ONBOARDING")]
    assert violations == 0


def test_customer_without_an_id_is_kept_and_rejected(spark):
    bronze = customers(spark, [customer(None)])
    silver = medallion.silver_customers(bronze)
    assert silver.filter("customer_id IS NULL").count() == 1
    rejected = medallion.silver_customers_rejected(bronze, silver, NOW).collect()
    assert [r["reason_code"] for r in rejected] == ["UNKNOWN"]


def test_unresolved_accounts_point_to_the_unknown_member(spark):
    bronze_customers = customers(spark, [customer(1), customer(2, date(2015, 1, 1))])
    silver = medallion.silver_customers(bronze_customers)
    owned = [account(1, 1), account(2, 2), account(3, 99), account(4, None), account(5, 1, kind="isa", status=" ")]
    bronze = accounts(spark, owned)
    owners = {r["account_id"]: r["customer_id"] for r in medallion.silver_accounts(bronze, silver).collect()}
    assert owners == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    rejected = medallion.silver_accounts_rejected(bronze, bronze_customers, silver, NOW)
    assert {r["account_id"]: r["reason_code"] for r in rejected.collect()} == {
        2: "CUSTOMER_REJECTED_UPSTREAM",
        3: "ORPHAN_CUSTOMER",
        4: "ORPHAN_CUSTOMER",
    }
    odd = medallion.silver_accounts(bronze, silver).filter("account_id = 5").first()
    assert odd["account_type"] is None and odd["status"] is None


def test_rounding_is_half_up_on_the_decimal_text(spark):
    silver = medallion.silver_customers(customers(spark, []))
    bronze = accounts(spark, [account(i, 1, b) for i, b in enumerate([1.005, 2.675, -2.5])])
    balances = [r["balance"] for r in medallion.silver_accounts(bronze, silver).orderBy("account_id").collect()]
    assert balances == [1.01, 2.68, -2.5]


def test_transactions_are_not_fanned_out(spark):
    silver = medallion.silver_customers(customers(spark, [customer(1)]))
    held = medallion.silver_accounts(accounts(spark, [account(1, 1, 100.0), account(2, 1, 50.0)]), silver)
    moment = datetime(2024, 1, 1)
    rows = [(i, 1, 10000.0 if i < 3 else 1.0, "gbp", moment, "", None) for i in range(5)]
    rows += [rows[0], (9, 1, 1.0, "gbp", datetime(2025, 1, 1), "POS", None), (10, 77, 1.0, "gbp", moment, "POS", None)]
    bronze = spark.createDataFrame(rows, BRONZE_SCHEMAS["bronze_transactions"])
    spending = medallion.silver_transactions(bronze, held, NOW)
    assert spending.count() == 5 and {r["currency"] for r in spending.collect()} == {"GBP"}
    for transactions in (spending, medallion.conformed_transactions(bronze, NOW)):
        gold = medallion.gold_customer_360(silver, held, transactions).filter("customer_id = 1").first()
        assert gold[-4:] == (2, 150.0, 5, 3)
    check = medallion.fanout_check(held, spending).first()
    assert (check["right_total"], check["fanned_out_total"]) == (150.0, 550.0)
    twice = held.filter("account_id = 2").withColumn("balance", F.lit(10.0)).select("customer_id", "account_id", "balance")
    three = spark.createDataFrame([(i, 2, 1.0) for i in range(3)], "txn_id BIGINT, account_id BIGINT, amount DOUBLE")
    check = medallion.fanout_check(twice.union(twice), three).first()
    assert (check["right_total"], check["fanned_out_total"]) == (20.0, 60.0)
    losses = quality.transaction_losses(bronze, held, bronze["txn_ts"] <= NOW)
    assert {r["cause"]: r["n_rows"] for r in losses.collect()} == {
        "LOADED": 5,
        "DUPLICATE": 1,
        "FUTURE_DATED": 1,
        "UNKNOWN_ACCOUNT": 1,
    }


def test_copies_of_one_frequent_row_are_written_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK", 100)
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS a", "CAST(NULL AS STRING) AS b")
    numbered = copies.number_copies(copies.tally(rows), first=2)
    hot = [r["copy_number"] for r in numbered.filter("a = -1").collect()]
    assert sorted(hot) == list(range(2, 1668)) and numbered.count() == len(hot)
    assert copies.number_copies(copies.tally(rows)).count() == 5000


def test_evolving_twice_adds_nothing(spark):
    silver = medallion.silver_customers(customers(spark, [customer(2, kyc_status="rejected"), customer(4), customer(5)]))
    once = medallion.evolve_customers(silver)
    twice = medallion.evolve_customers(once)
    assert once.columns == twice.columns and sorted(once.collect(), key=str) == sorted(twice.collect(), key=str)
    rows = {r["customer_id"]: r for r in once.collect()}
    assert rows[2]["kyc_status"] == "EXPIRED" and rows[4]["marketing_consent"] is None
    assert rows[5]["marketing_consent"] is True and rows[5]["customer_segment"] == "RETAIL"


def test_models_read_the_written_ones(spark, folder, tmp_path):
    lake = Lakehouse.over_test_tables(spark, folder)
    built = lake.build(str(tmp_path))
    assert list(built) == list(LINEAGE)
    fresh = Lakehouse.over_test_tables(spark, folder)
    for name in ("silver_accounts", "gold_customer_360"):
        assert built[name].exceptAll(fresh[name]).count() == 0 and built[name].dtypes == fresh[name].dtypes
    assert lake.build(str(tmp_path))["silver_accounts"].count() == 1500
    for reader in (lake, lake.in_session(spark.newSession())):  # nobody plans a built table again
        assert all(str(tmp_path) in file for file in reader["gold_customer_360"].inputFiles())
