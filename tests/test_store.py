"""Builds: one snapshot for readers, counts from the write, months, and checks before publishing."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import pytest

from touchstone.plans import lakehouse, medallion
from touchstone.plans.lakehouse import BRONZE, LINEAGE, TABLES, ConservationError, Lakehouse, deploy
from touchstone.plans.queries import QUERIES
from touchstone.sources import store, tables
from touchstone.sources.derived import derive

AS_OF = datetime(2004, 1, 1)


@pytest.fixture(scope="module")
def landed(spark, folder, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed"))
    for name in BRONZE:
        derive(spark, folder, name).write.parquet(f"{path}/{name}")
    return path


@pytest.fixture(scope="module")
def models(spark, landed, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    for _ in range(2):
        Lakehouse.over_folder(spark, landed, AS_OF).build(path)
    return path


def files_of(path) -> dict[str, float]:
    return {str(f): f.stat().st_mtime for f in Path(path).rglob("*.parquet")}


def test_two_builds_read_back_as_one(spark, landed, models):
    planned, read = Lakehouse.over_folder(spark, landed, AS_OF), Lakehouse.over_folder(spark, landed, AS_OF, models)
    for name in LINEAGE:
        assert read[name].dtypes == planned[name].dtypes
        assert read[name].exceptAll(planned[name]).count() == 0 == planned[name].exceptAll(read[name]).count()
    assert read["silver_customers"].count() == 140
    for name in LINEAGE:
        assert len(list(Path(models, name).glob("version=*"))) == 2  # the build before stays for its readers


def test_counts_come_from_the_write(spark, landed, models):
    planned, read = Lakehouse.over_folder(spark, landed, AS_OF), Lakehouse.over_folder(spark, landed, AS_OF, models)
    counts = read.row_counts()
    assert "FileScan" not in counts._jdf.queryExecution().toString()
    assert sorted(counts.collect()) == sorted(planned.row_counts().collect())
    columns = read.columns()
    assert "FileScan" not in columns._jdf.queryExecution().toString()
    assert sorted(columns.collect()) == sorted(planned.columns().collect())


def test_profiles_are_stored_with_the_build(spark, landed, models):
    planned, read = Lakehouse.over_folder(spark, landed, AS_OF), Lakehouse.over_folder(spark, landed, AS_OF, models)
    stored = read.profiles()
    assert all("_profiles" in file for file in stored.inputFiles())
    found, wanted = ({(r["table_name"], r["ordinal"]): r for r in p.collect()} for p in (stored, planned.profiles()))
    assert found.keys() == wanted.keys() and len({t for t, _ in found}) == len(TABLES)
    for key, row in found.items():
        ours, theirs = row.asDict(), wanted[key].asDict()
        for name in ("mean", "stddev"):
            assert ours.pop(name) == pytest.approx(theirs.pop(name), nan_ok=True)
        if ours["data_type"] == "DOUBLE":  # sums of money depend on the order of the rows
            for name in ("min_text", "max_text", "min_number", "max_number", "samples", "distinct_count", "distinct_pct"):
                ours.pop(name), theirs.pop(name)
        assert ours == theirs
    shown = read.profiles(mask=False).filter("column_name = 'email' AND table_name = 'silver_customers'").first()
    assert "***" not in shown["samples"][0]


def test_a_build_that_dies_changes_nothing(spark, landed, tmp_path, monkeypatch):
    path = str(tmp_path)
    lake = Lakehouse.over_folder(spark, landed, AS_OF)
    lake.build(path)
    before = files_of(path)

    def dying(*args):
        return args[0].sparkSession.range(1).selectExpr("raise_error('killed') AS month")

    monkeypatch.setattr(medallion, "gold_monthly_channel_volume", dying)
    with pytest.raises(Exception, match="killed"):
        Lakehouse.over_folder(spark, landed, AS_OF).build(path)
    assert store.latest(spark, path).number == 1 and files_of(path) == before
    assert Lakehouse.over_folder(spark, landed, AS_OF, path)["gold_monthly_channel_volume"].count() > 1


def test_lost_rows_stop_a_build(spark, landed, tmp_path, monkeypatch):
    kept = medallion.silver_accounts
    monkeypatch.setattr(medallion, "silver_accounts", lambda *a: kept(*a).filter("account_id % 100 > 0"))
    with pytest.raises(ConservationError, match="accounts: 1500 and 14"):
        Lakehouse.over_folder(spark, landed, AS_OF).build(str(tmp_path))
    assert store.latest(spark, str(tmp_path)) is None and not files_of(tmp_path)


def test_lost_money_stops_a_build(spark, landed, tmp_path, monkeypatch):
    kept = medallion.gold_customer_360
    monkeypatch.setattr(medallion, "gold_customer_360", lambda *a: kept(*a).filter("customer_id > 0"))
    with pytest.raises(ConservationError, match="balances"):
        Lakehouse.over_folder(spark, landed, AS_OF).build(str(tmp_path))


def test_only_a_month_is_read(spark, landed, models):
    lake = Lakehouse.over_folder(spark, landed, AS_OF, models)
    month = lake.month("silver_transactions", "1996-03")
    plan = month._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(txn_month" in plan and "1996-03" in plan
    files = [r[0] for r in month.select(lakehouse.F.input_file_name()).distinct().collect()]
    assert files and all("txn_month=1996-03" in file for file in files)
    planned = Lakehouse.over_folder(spark, landed, AS_OF).month("silver_transactions", "1996-03")
    assert planned.exceptAll(month).count() == 0 and month.columns == planned.columns


def test_only_a_month_is_refreshed(spark, folder, landed, tmp_path):
    models, bronze = str(tmp_path / "models"), str(tmp_path / "bronze")
    for name in BRONZE:
        spark.read.parquet(f"{landed}/{name}").write.parquet(f"{bronze}/{name}")
    lake = Lakehouse.over_folder(spark, bronze, AS_OF)
    lake.build(models)
    before = files_of(f"{models}/silver_transactions")
    late = spark.read.parquet(f"{bronze}/bronze_transactions")
    extra = late.filter("txn_ts >= '1996-03-01' AND txn_ts < '1996-04-01'").withColumn("txn_id", lakehouse.F.col("txn_id") + 10**9)
    extra.write.mode("append").parquet(f"{bronze}/bronze_transactions")
    fresh = Lakehouse.over_folder(spark, bronze, AS_OF, models)
    fresh.refresh_month("1996-03")
    after = files_of(f"{models}/silver_transactions")
    changed = {f for f in before.keys() ^ after.keys()} | {f for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed and all("txn_month=1996-03" in f for f in changed)
    planned = Lakehouse.over_folder(spark, bronze, AS_OF)
    for name in ("silver_transactions", "gold_customer_360", "gold_monthly_channel_volume"):
        assert planned[name].exceptAll(fresh[name]).count() == 0 == fresh[name].exceptAll(planned[name]).count()
    assert sorted(fresh.row_counts().collect()) == sorted(planned.row_counts().collect())
    assert sorted(fresh.columns(["silver_transactions"]).collect()) == sorted(planned.columns(["silver_transactions"]).collect())


def test_a_month_can_become_empty(spark, tmp_path):
    rows = spark.sql("SELECT id, concat('m', id % 3) AS m FROM range(30)")
    with store.Builder(spark, str(tmp_path)) as builder:
        builder.write("t", rows.select("id"), lakehouse.F.expr("concat('m', id % 3)"), "m")
        builder.publish()
    with store.Builder(spark, str(tmp_path)) as builder:
        builder.replace_directory("t", "m1", rows.select("id").limit(0))
        builder.publish()
    build = store.latest(spark, str(tmp_path))
    assert build.tables["t"].rows == 20 == tables.read_current(spark, str(tmp_path), "t").count()


def test_two_builds_at_once(spark, tmp_path):
    with store.Builder(spark, str(tmp_path)) as one, pytest.raises(store.BuildError, match="published in the meantime"):
        with store.Builder(spark, str(tmp_path)) as two:
            one.write("t", spark.range(3))
            two.write("t", spark.range(5))
            one.publish()
            two.publish()
    assert tables.read_current(spark, str(tmp_path), "t").count() == 3
    assert len(files_of(tmp_path)) == len(files_of(tmp_path / "t" / Path(store.latest(spark, str(tmp_path)).tables["t"].parts[0]).name))


def test_appended_parts_are_read_together(spark, tmp_path):
    tables.append_rows(spark.range(3), str(tmp_path), "t")
    tables.append_rows(spark.range(4), str(tmp_path), "t")
    version = store.latest(spark, str(tmp_path)).tables["t"]
    assert len(version.parts) == 2 and version.rows == 7 and version.values == {"id": 7}
    assert tables.read_current(spark, str(tmp_path), "t").count() == 7


def test_catalog_queries_write_nothing(spark, folder, tmp_path):
    """Planned while there is no build; from the stored counts and profiles afterwards."""
    other = spark.newSession()
    names = ["catalog_profile", "catalog_columns", "table_row_counts", "lineage_direct", "scoped_table_list"]
    before = {name: sorted(map(str, QUERIES[name](other, folder).collect())) for name in names}
    shared = Path(lakehouse.shared_dir(spark))
    written = files_of(shared)
    for name in names:
        QUERIES[name](spark, folder)
    assert files_of(shared) == written
    deploy(spark, folder)
    for name in names:
        assert sorted(map(str, QUERIES[name](spark, folder).collect())) == before[name]
    assert Lakehouse.deployed(spark, folder).built("silver_accounts") is not None


@pytest.mark.parametrize("empty", [BRONZE, ["bronze_accounts"], ["bronze_customers"], ["bronze_transactions"]])
def test_empty_tables_are_built(spark, landed, tmp_path, empty):
    bronze = str(tmp_path / "bronze")
    for name in BRONZE:
        rows = spark.read.parquet(f"{landed}/{name}")
        (rows.limit(0) if name in empty else rows).write.parquet(f"{bronze}/{name}")
    lake = Lakehouse.over_folder(spark, bronze, AS_OF)
    lake.build(str(tmp_path / "models"))
    counts = {r["table_name"]: r["n_rows"] for r in lake.row_counts().collect()}
    assert counts == {name: lake[name].count() for name in TABLES} and all(counts[name] == 0 for name in empty)
    assert lake.profiles().count() == lake.columns().count()
