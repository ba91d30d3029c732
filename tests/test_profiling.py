from __future__ import annotations

from datetime import date

from pyspark.sql.types import DoubleType

from touchstone.operators import profiling

PEOPLE = "id BIGINT, email STRING, born DATE, score DOUBLE, active BOOLEAN"
ROWS = [
    (1, "ann@x.com", date(1990, 1, 1), 2.0, True),
    (2, "bob@x.com", None, 4.0, True),
    (3, None, date(1980, 5, 5), 4.0, None),
    (10, "ann@x.com", date(1985, 1, 1), None, False),
]


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


def test_profile(spark):
    rows = by_column(profiling.profile(spark.createDataFrame(ROWS, PEOPLE), "silver_people"))
    number, email, born, score, active = (rows[c] for c in ["id", "email", "born", "score", "active"])
    assert (number["min_text"], number["max_text"], number["samples"]) == ("1", "10", ["1", "2", "3", "10"])
    assert (email["null_count"], email["null_pct"], email["distinct_count"], email["distinct_pct"]) == (1, 25.0, 2, 50.0)
    assert email["samples"] == ["a***@x.com", "b***@x.com"] and email["min_text"] is None
    assert (born["min_text"], born["max_text"], born["mean"]) == ("1980-05-05", "1990-01-01", None)
    assert (score["min_number"], score["max_number"], round(score["mean"], 6)) == (2.0, 4.0, 3.333333)
    assert active["samples"] == ["false", "true"] and active["data_type"] == "BOOLEAN"


def test_unmasked_profile_and_own_personal_columns(spark):
    df = spark.createDataFrame(ROWS, PEOPLE)
    assert by_column(profiling.profile(df, "t", mask=False))["email"]["samples"][0] == "ann@x.com"
    born = by_column(profiling.profile(df, "t", personal=["born"]))["born"]
    assert born["min_text"] == "1*********" and born["is_personal"]


def test_empty_table_and_single_row(spark):
    empty = by_column(profiling.profile(spark.createDataFrame([], PEOPLE), "t"))["score"]
    assert (empty["row_count"], empty["null_pct"], empty["distinct_pct"], empty["min_text"]) == (0, 0.0, 0.0, None)
    assert empty["samples"] == []
    single = by_column(profiling.profile(spark.createDataFrame(ROWS[:1], PEOPLE), "t"))["score"]
    assert single["stddev"] is None and single["mean"] == 2.0


def test_large_whole_numbers_stay_exact(spark):
    df = spark.createDataFrame([(2**53 + 1,), (2**53,), (-(2**60),)], "v BIGINT")
    row = by_column(profiling.profile(df, "t"))["v"]
    assert row["distinct_count"] == 3 and row["max_text"] == str(2**53 + 1)
    assert row["samples"] == [str(-(2**60)), str(2**53), str(2**53 + 1)]


def test_decimals_sort_as_numbers_and_doubles_have_no_exponent(spark):
    df = spark.sql("SELECT CAST(v AS DECIMAL(9,1)) AS d FROM VALUES (100), (2), (30), (4), (500), (9), (10), (-3.5) AS t(v)")
    row = by_column(profiling.profile(df, "t"))["d"]
    assert row["samples"] == ["-3.5", "2.0", "4.0", "9.0", "10.0"] and row["distinct_count"] == 8
    values = [1e-20, 3.5e-18, -1.25e-7, 1.5e7, 123456789.125, 1e300, -2e22, 0.5]
    rows = spark.createDataFrame([(v,) for v in values], "v DOUBLE").selectExpr("v", f"{profiling.as_text('v', DoubleType())} AS t")
    for r in rows.collect():
        assert "E" not in r["t"] and float(r["t"]) == r["v"]
    assert {r["t"] for r in rows.filter("abs(v) < 1e-10").collect()} == {"0.00000000000000000001", "0.0000000000000000035"}


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2)], ["it's", "back\\slash"])
    assert set(by_column(profiling.profile(df, "t"))) == set(df.columns)
    assert [r["column_name"] for r in profiling.column_listing({"t": df}).collect()] == df.columns


def test_estimates_need_no_shuffle_of_values(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS d")
    rows = by_column(profiling.profile(df, "t", exact=False))
    assert rows["d"]["distinct_count"] == 7 and abs(rows["id"]["distinct_count"] - 1000) < 100
    assert rows["d"]["samples"] == []


def test_card(spark):
    rows = profiling.profiles({"gold_people": spark.createDataFrame(ROWS, PEOPLE)})
    catalog = profiling.catalog(rows, ["gold_people"], {"gold_people": ["silver_people"]}, {}, "Unassigned")
    lines = profiling.cards(catalog).first()["card"].split("\n")
    assert lines[:5] == [
        "# Table: gold_people",
        "- Medallion layer: **gold**",
        "- Business domain / owner: Unassigned",
        "- Row count: 4",
        "- Upstream tables (lineage): silver_people",
    ]
    assert lines[9] == "| id | BIGINT | 0.0% | 4 |  | 1 | 10 | 1, 2, 3, 10 |"
    assert lines[10] == "| email | VARCHAR | 25.0% | 2 | yes | None | None | a***@x.com, b***@x.com |"


def test_only_the_samples_of_a_column_are_shuffled(spark, capsys):
    profiling.smallest_values(profiling.distinct_values({"t": spark.range(1000).toDF("v")}), ["t"]).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2
