"""Contract files, diffs, versions and drift."""

from __future__ import annotations

import copy
import json

import pytest

from touchstone.operators import contract_diff, drift
from touchstone.sources import contracts, tables

COLUMN = "contract_id STRING, name STRING, type STRING, nullable BOOLEAN, pii BOOLEAN, description STRING"
RULE = "contract_id STRING, name STRING, severity STRING, assertion STRING"
HEADER = (
    "contract_id STRING, version STRING, domain STRING, owner STRING, description STRING, freshness STRING, "
    "change_log ARRAY<STRUCT<version: STRING, note: STRING>>"
)
BASE = ("t", "city", "VARCHAR", True, False, "c")


def changed(**fields):
    names = ["contract_id", "name", "type", "nullable", "pii", "description"]
    return tuple((dict(zip(names, BASE, strict=True)) | fields).values())


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        (None, changed(), ("added", "additive")),
        (None, changed(nullable=None), ("added", "additive")),
        (None, changed(nullable=False), ("added", "breaking")),
        (changed(), None, ("removed", "breaking")),
        (changed(), changed(type="DATE"), ("modified", "breaking")),
        (changed(), changed(nullable=False), ("modified", "breaking")),
        (changed(nullable=False), changed(), ("modified", "additive")),
        (changed(nullable=None), changed(nullable=False), ("modified", "metadata")),
        (changed(), changed(pii=True), ("modified", "breaking")),
        (changed(pii=None), changed(pii=False), ("modified", "breaking")),
        (changed(nullable=False), changed(nullable=True, pii=True), ("modified", "additive")),
        (changed(), changed(description="d"), ("modified", "metadata")),
        (changed(), changed(), None),
    ],
)
def test_column_changes(spark, old, new, expected):
    sides = [spark.createDataFrame([row] if row else [], COLUMN) for row in (old, new)]
    found = [(r["kind"], r["classification"]) for r in contract_diff.column_changes(*sides).collect()]
    assert found == ([expected] if expected else [])


def test_rule_changes(spark):
    old = spark.createDataFrame([("t", "a", "blocking", "x"), ("t", "b", "blocking", "y"), ("t", "c", "w", "z")], RULE)
    new = spark.createDataFrame([("t", "a", "review", "x"), ("t", "c", "w", "z"), ("t", "d", "w", "z")], RULE)
    found = {r["path"]: (r["kind"], r["classification"]) for r in contract_diff.rule_changes(old, new).collect()}
    assert found == {
        "quality_rules.a": ("modified", "breaking"),
        "quality_rules.b": ("removed", "breaking"),
        "quality_rules.d": ("added", "additive"),
    }


def test_versions_and_history(spark, tmp_path):
    old = spark.createDataFrame(
        [(i, v, "d", "o", "x", None, [(v, "first")]) for i, v in [("a", "2.0.0"), ("b", "2.3.1"), ("c", "2.3.1")]], HEADER
    )
    new = spark.createDataFrame([(i, "9.9.9", "d", "p", "x", None, None) for i in "abc"], HEADER)
    headers = contract_diff.header_changes(old, new)
    columns = contract_diff.column_changes(
        spark.createDataFrame([], COLUMN),
        spark.createDataFrame([changed(contract_id="a", nullable=False), changed(contract_id="b")], COLUMN),
    )
    versions = contract_diff.next_versions(contract_diff.summary(old, headers.unionByName(columns)))
    found = {r["contract_id"]: (r["level"], r["next_version"], r["metadata"]) for r in versions.collect()}
    assert found == {"a": ("major", "3.0.0", 1), "b": ("minor", "2.4.0", 1), "c": ("patch", "2.3.2", 1)}
    log = contract_diff.history(old, versions).filter("contract_id = 'a'").orderBy("position").collect()
    assert [(r["version"], r["note"]) for r in log] == [
        ("3.0.0", "0 additive, 1 breaking, 1 metadata"),
        ("2.0.0", "first"),
    ]
    written = contract_diff.promote(str(tmp_path), old, new, headers.unionByName(columns))
    assert sorted(map(str, written.collect())) == sorted(map(str, contract_diff.promoted(new, versions).collect()))
    log = tables.read_current(spark, str(tmp_path), "contract_history")
    assert sorted(map(str, log.collect())) == sorted(map(str, contract_diff.history(old, versions).collect()))
    promoted = contract_diff.promoted(new, versions).filter("contract_id = 'b'").first()
    assert (promoted["version"], promoted["owner"]) == ("2.4.0", "p")
    text = contract_diff.document(headers.unionByName(columns), "a").orderBy("position").collect()
    lines = [r["line"] for r in text]
    assert lines[0] == "# a" and "consumer_guarantees" in lines[2] and lines[4:6] == contract_diff.REPORT_HEAD and len(lines) == 8
    assert contract_diff.document(headers, "z").orderBy("position").collect()[-1]["line"] == contract_diff.NO_CHANGES


def test_losing_a_rule_is_a_major_version(spark, tmp_path):
    """A revision that widens a list, adds two columns and forgets a rule."""
    old = contracts.load_contract("silver_customers")
    new = copy.deepcopy(old)
    new["schema"] += [
        {"name": "marketing_consent", "type": "BOOLEAN", "nullable": True, "pii": False, "description": "opt-in"},
        {"name": "customer_segment", "type": "VARCHAR", "nullable": False, "pii": False, "description": "segment"},
    ]
    new["quality_rules"] = [r for r in new["quality_rules"] if r["name"] != "unknown_member_present"]
    new["quality_rules"][2]["assertion"] = new["quality_rules"][2]["assertion"].replace("'REJECTED'", "'REJECTED','EXPIRED'")
    sides = []
    for name, contract in (("old", old), ("new", new)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "c.json").write_text(json.dumps(contract))
        sides.append(contracts.read_contracts(spark, str(tmp_path / name)))
    changes = contract_diff.column_changes(*map(contracts.contract_columns, sides)).unionByName(
        contract_diff.rule_changes(*map(contracts.contract_rules, sides))
    )
    found = {r["path"]: r["classification"] for r in changes.collect()}
    assert found == {
        "schema.marketing_consent": "additive",
        "schema.customer_segment": "breaking",
        "quality_rules.kyc_status_enum": "breaking",
        "quality_rules.unknown_member_present": "breaking",
    }
    versions = contract_diff.next_versions(contract_diff.summary(contracts.contract_headers(sides[0]), changes))
    assert versions.first()["next_version"] == "3.0.0"
    lines = {r["path"]: r["line"] for r in contract_diff.report(changes).collect()}
    assert lines["schema.customer_segment"] == (
        "| schema.customer_segment | added | **breaking** | None → VARCHAR NOT NULL |"
    )


def test_contract_tables(spark, tmp_path):
    tables = contracts.read_contracts(spark, str(contracts.SHIPPED))
    assert contracts.contract_columns(tables).count() == 9
    assert contracts.contract_rules(tables).count() == 7
    assert {r["column_name"]: r["null_rate"] for r in contracts.contract_expectations(tables).collect()}["city"] == 0.12


def test_unusable_contracts(tmp_path):
    with pytest.raises(FileNotFoundError, match="no approved contract"):
        contracts.load_contract("silver_accounts", tmp_path)
    (tmp_path / "t.json").write_text(json.dumps({"schema": [{"column": "id", "type": "BIGINT"}]}))
    with pytest.raises(ValueError, match="entry 1 of schema has no name"):
        contracts.load_contract("t", tmp_path)


def test_yaml_contract(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "t.yml").write_text("schema:\n  - {name: id, type: BIGINT, nullable: false}\n")
    assert contracts.load_contract("t", tmp_path)["schema"][0]["nullable"] is False


def test_listed_values_of_a_rule(spark):
    text = "SELECT count(*) FROM t WHERE \"kyc\" IS NOT NULL and KYC NOT IN ('A', \"B\",'C')"
    other = "SELECT count(*) FROM t WHERE a IS NOT NULL AND b NOT IN ('A')"
    assert drift.listed_values(spark, [{"assertion": text}, {"assertion": other}]) == {"kyc": ["A", "B", "C"]}
    rules = spark.createDataFrame([("r", text), ("s", "SELECT 1")], "name STRING, assertion STRING")
    assert [r["value"] for r in drift.parse_enum_rules(rules).collect()] == ["A", "B", "C"]


CONTRACT = {
    "schema": [
        {"name": "id", "type": "bigint", "nullable": False},
        {"name": "kind", "type": "VARCHAR"},
        {"name": "size", "type": "BIGINT"},
        {"name": "gone", "type": "DATE"},
    ],
    "quality_rules": [
        {
            "name": "kinds",
            "severity": "blocking",
            "assertion": "SELECT count(*) FROM t WHERE kind IS NOT NULL AND kind NOT IN ('A','B')",
        },
        {"name": "nothing", "assertion": "SELECT sum(size) FROM t WHERE id < 0"},
        {"name": "broken", "severity": "review", "assertion": "SELECT count(*) FROM t WHERE no_such_column > 1"},
        {"name": "unreadable", "severity": "review", "assertion": "SELEC 1"},
        {
            "name": "two_tables",
            "severity": "blocking",
            "assertion": "SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM u)",
        },
    ],
    "profile_expectations": {
        "row_count_min": 5,
        "null_rate_tolerance": 0.25,
        "columns": {"kind": {"null_rate": 0.25}, "size": {"null_rate": 0.0}},
    },
}


def test_all_kinds_of_drift(spark):
    df = spark.createDataFrame(
        [(1, "A", 1, True), (None, "C", None, True), (3, "D", None, True), (4, None, 4, True)],
        "id BIGINT, kind STRING, size INT, extra BOOLEAN",
    )
    df.createOrReplaceTempView("t")
    spark.range(3).createOrReplaceTempView("u")
    checks = drift.checks(df, "t", CONTRACT, spark.sql)
    found = {(r["kind"], r["subject"]): r for r in drift.report(checks).collect()}
    assert {key: r["severity"] for key, r in found.items()} == {
        ("SCHEMA_ADDED", "extra"): "review",
        ("SCHEMA_REMOVED", "gone"): "breaking",
        ("TYPE_CHANGED", "size"): "review",
        ("NULLABILITY", "id"): "breaking",
        ("NULL_RATE", "size"): "review",  # kind deviates by exactly nothing
        ("ROW_COUNT", "*"): "breaking",
        ("ENUM_EXPANDED", "kind"): "review",
        ("RULE_FAILING", "kinds"): "blocking",
        ("RULE_FAILING", "broken"): "breaking",
        ("RULE_FAILING", "unreadable"): "breaking",
        ("RULE_FAILING", "two_tables"): "blocking",
    }
    details = {r["detail"] for r in checks.filter("kind = 'ENUM_EXPANDED'").collect()}
    assert details == {f"kind has a value outside the list: {v}, in 1 rows" for v in "CD"}
    text = [r["line"] for r in drift.document(checks, "t").orderBy("position").collect()]
    assert text[2:4] == drift.REPORT_HEAD and len(text) == 16 and text[4].startswith("| ENUM_EXPANDED | kind")
    assert drift.document(checks.limit(0), "t").orderBy("position").collect()[-1]["line"] == drift.NO_DRIFT
    with pytest.raises(drift.DriftError, match="12 checks drifted"):
        drift.require_no_drift(checks)


@pytest.mark.parametrize(("nulls", "drifts"), [(4, 0), (5, 1)])
def test_null_rate_may_deviate_by_the_tolerance(spark, nulls, drifts):
    contract = {"schema": [], "profile_expectations": {"null_rate_tolerance": 0.25, "columns": {"v": {"null_rate": 0.25}}}}
    df = spark.range(8).selectExpr(f"CASE WHEN id >= {nulls} THEN id END AS v")
    checks = drift.checks(df, "t", contract, spark.sql, ["NULL_RATE"])
    assert drift.gate(checks).first()["n_drifts"] == drifts


def test_a_report_has_a_row_for_every_value_outside_a_list(spark):
    df = spark.range(60).selectExpr("concat('v', lpad(id % 30, 2, '0')) AS kind")
    contract = {"schema": [], "quality_rules": CONTRACT["quality_rules"][:1]}
    found = drift.report(drift.checks(df, "t", contract, spark.sql, ["ENUM_EXPANDED"])).collect()
    assert len(found) == 30 and {r["observed"] for r in found} == {2.0}
    assert {r["detail"] for r in found} == {f"kind has a value outside the list: v{i:02}, in 2 rows" for i in range(30)}


def test_every_rule_gives_one_row_and_one_failure_stays_alone(spark):
    rules = [
        ("divides", "SELECT count(*) FROM t WHERE 1 / id > 5"),
        ("grouped", "SELECT count(*) FROM t WHERE id >= 0 GROUP BY id % 2"),
        ("limited", "SELECT count(*) FROM t WHERE id > 1 LIMIT 1"),
        ("plain", "SELECT 0 * id FROM t"),
        ("boolean", "SELECT max(id) > 2 FROM T"),
        ("few", "SELECT count(*) FROM t WHERE id > 3"),
        ("distinct", "SELECT count(*) - count(DISTINCT id) FROM t"),
        ("unreadable", "SELECT FROM WHERE"),
        ("lost", "SELECT count(*) FROM no_such_table"),
    ]
    df = spark.range(5)
    df.createOrReplaceTempView("t")
    contract = {"schema": [], "quality_rules": [{"name": n, "assertion": a, "severity": "blocking"} for n, a in rules]}
    found = {r["subject"]: r for r in drift.checks(df, "t", contract, spark.sql, ["RULE_FAILING"]).collect()}
    assert {n: r["observed"] for n, r in found.items()} == {
        "divides": None, "grouped": 3.0, "limited": 3.0, "plain": 0.0, "boolean": 1.0, "few": 1.0, "distinct": 0.0,
        "unreadable": None, "lost": None,
    }
    assert {n for n, r in found.items() if r["severity"] == "breaking" and r["drifted"]} == {"divides", "unreadable", "lost"}
    assert "DIVIDE_BY_ZERO" in found["divides"]["detail"]


def test_rules_of_one_table_share_a_pass(spark):
    rules = [
        {"name": "keys", "assertion": "SELECT count(*) - count(DISTINCT id) FROM t"},
        {"name": "one", "assertion": "SELECT abs(1 - count_if(id = 0)) FROM t"},
        {"name": "few", "assertion": "SELECT count(*) FROM t WHERE id > 3"},
    ]

    def unused(sql: str):
        raise AssertionError(sql)

    df = spark.createDataFrame([(1,), (1,), (None,)], "id BIGINT")
    found = drift.checks(df, "t", {"schema": [], "quality_rules": rules}, unused, ["RULE_FAILING"]).collect()
    assert {r["subject"]: r["observed"] for r in found} == {"keys": 2.0, "one": 1.0, "few": 0.0}


def test_nothing_to_check(spark):
    assert drift.checks(spark.range(1), "t", {"schema": []}, spark.sql, ["NULLABILITY"]).count() == 0
