from __future__ import annotations

from datetime import datetime

import pytest

from touchstone.plans.lakehouse import Lakehouse
from touchstone.session import isolated, materialise, settings_for, shared_dir
from touchstone.sources import tables
from touchstone.sources.derived import derive


def test_landed_tables_have_their_declared_types(spark, folder, tmp_path):
    derive(spark, folder, "bronze_transactions").write.parquet(str(tmp_path / "bronze_transactions"))
    landed = tables.read_bronze(spark, str(tmp_path), "bronze_transactions")
    assert landed.count() == 6030 and landed.schema["txn_ts"].dataType.simpleString() == "timestamp_ntz"
    with pytest.raises(KeyError, match="not a declared source"):
        tables.read_bronze(spark, str(tmp_path), "silver_customers")


def test_lakehouse_over_landed_files(spark, folder, tmp_path):
    for name in tables.BRONZE_SCHEMAS:
        derive(spark, folder, name).write.parquet(str(tmp_path / name))
    lake = Lakehouse.over_folder(spark, str(tmp_path), datetime(2004, 1, 1))
    assert lake["gold_customer_360"].exceptAll(Lakehouse.over_test_tables(spark, folder)["gold_customer_360"]).count() == 0
    lake.build(str(tmp_path / "models"))
    later = Lakehouse.over_folder(spark, str(tmp_path), datetime(2004, 1, 1), str(tmp_path / "models"))
    assert later["silver_transactions"].count() == 5811
    assert all("models" in file for file in later["silver_transactions"].inputFiles())
    with pytest.raises(KeyError):
        lake["no_such_table"]


def test_projected_columns_have_the_declared_types(spark, folder):
    for name, schema in tables.BRONZE_SCHEMAS.items():
        declared = spark.createDataFrame([], schema)
        assert derive(spark, folder, name).dtypes == declared.dtypes


def test_refresh_replaces_and_append_adds(spark, tmp_path):
    folder = str(tmp_path)
    tables.write_full_refresh(spark.range(5), folder, "t")
    assert tables.write_full_refresh(spark.range(3), folder, "t").count() == 3
    broken = spark.range(4).selectExpr("raise_error('lost') AS id")
    with pytest.raises(Exception, match="lost"):
        tables.write_full_refresh(broken, folder, "t")
    assert tables.read_current(spark, folder, "t").count() == 3  # a failed refresh leaves the table as it was
    for n in (1, 2, 6):
        tables.write_full_refresh(spark.range(n), folder, "t")
    assert tables.read_current(spark, folder, "t").count() == 6 and len(tables.versions(spark, folder, "t")) == 2
    with pytest.raises(FileNotFoundError):
        tables.read_current(spark, folder, "nothing")
    tables.append_rows(spark.range(2), folder, "t")
    assert tables.read_current(spark, folder, "t").count() == 8


def test_json_and_reports(spark, tmp_path):
    folder = str(tmp_path)
    tables.write_json(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), folder, "doc")
    assert spark.read.text(f"{folder}/doc").first()[0] == '{"a":1,"b":null}'
    tables.write_report(spark.sql("SELECT 'line' AS l"), folder, "../../escape.md")
    assert spark.read.text(f"{folder}/escape.md").first()[0] == "line"
    with pytest.raises(ValueError, match="must end in"):
        tables.write_report(spark.sql("SELECT 'line' AS l"), folder, "script.sh")


def test_reports_keep_their_order(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "concat('line ', id) AS l").repartition(7)
    tables.write_report(tables.document(rows, ["id"], "l", ["# head", ""], "none"), str(tmp_path), "r.md")
    (file,) = (tmp_path / "r.md").glob("part-*")
    assert file.read_text().splitlines() == ["# head", "", *[f"line {i}" for i in range(500)]]
    empty = tables.document(rows.limit(0), ["id"], "l", ["# head"], "none").orderBy("position").collect()
    assert [r["line"] for r in empty] == ["# head", "none"]


def test_written_copies_go_to_the_shared_folder(spark):
    copy = materialise(spark.range(4), "numbers")
    assert all(file.removeprefix("file://").startswith(shared_dir(spark)) for file in copy.inputFiles())
    assert copy.count() == 4


def test_isolated_session_keeps_settings_and_drops_views(spark):
    spark.range(1).createOrReplaceTempView("only_in_parent")
    child = isolated(spark)
    assert child.conf.get("spark.sql.session.timeZone") == "UTC"
    assert "only_in_parent" not in [t.name for t in child.catalog.listTables()]


def test_shuffle_partitions_follow_the_input():
    def partitions(size):
        return int(settings_for(size)["spark.sql.shuffle.partitions"])

    assert partitions(10**9) == 200 and partitions(10 * 1024**4) == 20480 and partitions(100 * 1024**4) == 204_800
