"""Text, date and vector rules on the values that are easy to get wrong."""

from __future__ import annotations

import math
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from touchstone.functions import dates, text, vectors
from touchstone.operators import profiling


def applied(spark, rule, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("v"))).collect()]


MASKS = {
    "ann@x.com": "a***@x.com",
    "a(at)x.com": "a*********",
    "": "*",
    "z": "*",
    None: None,
    "@x": "***@x",
    "a@b@c": "a***@b@c",
    "1999-01-02": "1*********",
}


def test_masks(spark):
    assert applied(spark, text.masked, list(MASKS)) == list(MASKS.values())


def hidden(value: str) -> str:
    at = value.find("@")
    if at >= 0:
        return value[: min(at, 1)] + "***@" + value[at + 1 :]
    return "*" if len(value) < 2 else value[0].ljust(len(value), "*")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=12), min_size=20, max_size=60))
def test_masks_of_any_text(spark, values):
    assert applied(spark, text.masked, values) == [hidden(v) for v in values]


def test_only_the_first_letter_of_a_name_is_raised(spark):
    names = ["new YORK", "o'neil smith-jones", "", "x", "  padded ", None]
    assert applied(spark, text.capitalised, names) == ["New york", "O'neil smith-jones", "", "X", "Padded", None]


def test_codes(spark):
    assert applied(spark, text.code, [" open ", "", "   ", None, "\tx"]) == ["OPEN", None, None, None, "\tX"]


def test_emails(spark):
    values = ["A@B.c", "a(at)b.c", "a@b", None]
    assert applied(spark, text.plausible_email, values) == ["a@b.c", None, None, None]


def test_leap_day_falls_back(spark):
    days = [date(2022, 2, 28), date(2022, 3, 1), date(2024, 2, 29), None]
    assert applied(spark, dates.latest_adult_birth, days, "date") == [
        date(2004, 2, 28),
        date(2004, 3, 1),
        date(2006, 2, 28),
        None,
    ]


def test_month_keeps_no_time_zone(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 31, 23, 59),)], "v TIMESTAMP_NTZ").select(
        dates.month_of(F.col("v")).alias("m")
    )
    assert df.dtypes == [("m", "timestamp_ntz")] and df.first()["m"] == datetime(2024, 3, 1)


def test_numbers_have_no_exponent(spark):
    values = [12500000.0, 1.5, -0.001, 1e-5, 0.0, 98765432.1, None, 1e300, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v DOUBLE")
    kind = df.schema["v"].dataType
    assert [r[0] for r in df.selectExpr(profiling.as_text("v", kind)).collect()] == [
        "12500000.0", "1.5", "-0.001", "0.00001", "0.0", "98765432.1", None, "1" + 300 * "0" + ".0", "NaN",
    ]


def test_json_has_no_nan_and_iso_moments(spark):
    df = spark.createDataFrame(
        [(1, float("nan"), datetime(2024, 1, 2, 3, 4, 5), date(2024, 1, 2), None)],
        "a INT, b DOUBLE, c TIMESTAMP_NTZ, d DATE, e STRING",
    )
    assert df.select(text.json_document(df.schema)).first()[0] == (
        '{"a":1,"b":null,"c":"2024-01-02T03:04:05","d":"2024-01-02","e":null}'
    )
    parts = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-02 03:04:05.678901' AS c UNION ALL SELECT CAST(NULL AS TIMESTAMP_NTZ)")
    assert [r[0] for r in parts.select(text.json_document(parts.schema)).collect()] == [
        '{"c":"2024-01-02T03:04:05.678901"}', '{"c":null}',
    ]


def test_tables_are_found_as_whole_words(spark):
    log = spark.createDataFrame(
        [(1, "SELECT * FROM Silver_Customers WHERE city = 'London'"), (2, "FROM silver_customers_rejected"), (3, "x")],
        "id INT, q STRING",
    )
    found = text.table_references(log, "q", ["silver_customers", "silver_customers_rejected"]).collect()
    assert sorted((r["id"], r["table_name"]) for r in found) == [(1, "silver_customers"), (2, "silver_customers_rejected")]


def test_verdicts(spark):
    reviews = ["fine\nVERDICT: APPROVE", "verdict:revise", "VERDICT: perhaps", "", None]
    assert applied(spark, text.verdict, reviews) == ["APPROVE", "REVISE", "REVISE", "REVISE", "REVISE"]


def test_unit_vectors(spark):
    unit, zero = applied(spark, vectors.normalised, [[3.0, 4.0], [0.0, 0.0]], "ARRAY<FLOAT>")
    assert unit == pytest.approx([0.6, 0.8]) and zero == [0.0, 0.0]
    assert math.isclose(sum(x * x for x in unit), 1.0)
