"""One key holds a third of all rows: results stay whole and no join task gets all of it.

Broadcasts are off and the thresholds tiny, so small tables take the path of large ones.
"""

from __future__ import annotations

import pytest

from touchstone.operators import copies, keyed, quality
from touchstone.plans import medallion
from touchstone.plans.lakehouse import AS_OF

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
    "spark.sql.shuffle.partitions": "12",
}
N = 30_000


@pytest.fixture
def large(spark):
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


def customers(spark):
    return spark.range(1, 1000).selectExpr(
        "id AS customer_id", "'ann' AS first_name", "'lee' AS last_name", "CAST(NULL AS STRING) AS email",
        "DATE '1980-01-01' AS date_of_birth", "'Leeds' AS city", "'VERIFIED' AS kyc_status", "1 AS risk_rating",
        "DATE '2020-01-01' AS created_at",
    )


def accounts(spark, hot):
    return spark.range(0, N, 1, 8).selectExpr(
        "id AS account_id", f"CASE WHEN id % 3 = 0 THEN {hot} ELSE id % 1200 + 1 END AS customer_id",
        "'CUR' AS account_type", "1.0D AS balance", "'GBP' AS currency", "DATE '2020-01-01' AS opened_date", "'open' AS status",
    )


def final_plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("hot", ["7", "CAST(NULL AS BIGINT)"])
def test_accounts_of_one_customer_are_split(large, capsys, hot):
    silver = medallion.silver_accounts(accounts(large, hot), medallion.silver_customers(customers(large)))
    rows = silver.collect()
    assert len(rows) == N and sum(r["balance"] for r in rows) == N
    owner = 7 if hot == "7" else 0
    assert sum(r["customer_id"] == owner for r in rows) >= N // 3
    assert "skew=true" in final_plan(silver, capsys)


def test_anti_join_of_one_customer_is_split(large, capsys):
    lost = keyed.without(accounts(large, "7"), large.range(8, 2000).toDF("customer_id"), "customer_id")
    assert len(lost.collect()) == N // 3 + sum(1 for i in range(N) if i % 3 and i % 1200 + 1 <= 7)
    assert "skew=true" in final_plan(lost, capsys)


def test_transactions_of_one_account(large, capsys):
    held = accounts(large, "7")
    bronze = large.range(0, N, 1, 8).selectExpr(
        "id AS txn_id", "CASE WHEN id % 3 = 0 THEN 5 ELSE id + 1000 END AS account_id", "20000.0D AS amount",
        "'GBP' AS currency", "TIMESTAMP_NTZ '2003-01-01 00:00:00' AS txn_ts", "'POS' AS channel", "1 AS merchant_category_code",
    )
    silver = medallion.silver_transactions(bronze, held, AS_OF)
    known = N // 3 + sum(1 for i in range(N) if i % 3 and i + 1000 < N)
    assert len(silver.collect()) == known
    assert "skew=true" in final_plan(silver, capsys)
    losses = {r["cause"]: r["n_rows"] for r in quality.transaction_losses(bronze, held, bronze["txn_ts"] <= AS_OF).collect()}
    assert losses["LOADED"] == known and losses["LOADED"] + losses["UNKNOWN_ACCOUNT"] == N and losses["DUPLICATE"] == 0
    activity = medallion.account_activity(held.selectExpr("*"), silver).filter("account_id = 5").first()
    assert activity["n_txns"] == activity["n_large_txns"] == N // 3


def test_copies_are_combined_before_the_shuffle(large, capsys):
    rows = large.range(0, N, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS a")
    tallied = copies.tally(rows)
    assert tallied.filter("a = -1").first()[copies.COPIES] == N // 3
    plan = final_plan(tallied, capsys)
    assert plan.index("partial_count") > plan.index("Exchange") > 0  # printed from the result downwards
    shared = copies.with_group_size(rows.selectExpr("a", "a AS b"), ["a"], "n")
    assert {tuple(r) for r in shared.collect()} == {(-1, -1, N // 3)} and shared.count() == N // 3


def test_first_row_of_a_frequent_key(large):
    rows = large.range(0, N, 1, 8).selectExpr("CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "-id AS v")
    first = copies.first_per_key(rows, "k", rows["v"].asc())
    assert first.filter("k = -1").first()["v"] == -(N - 3) and first.count() == N - N // 3 + 1
