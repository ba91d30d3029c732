"""The named tables of the lakehouse and how they depend on each other."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from touchstone.functions.dates import month_label
from touchstone.operators import profiling
from touchstone.plans import medallion
from touchstone.session import drop_at_exit, has_shared_dir, scratch_path, shared_dir
from touchstone.sources import store
from touchstone.sources.derived import SOURCES, derive
from touchstone.sources.tables import read_bronze

AS_OF = datetime(2004, 1, 1)  # the test data ends before it

# What each model is built from, and who owns which subject.
LINEAGE = {
    "silver_customers": ["bronze_customers"],
    "silver_customers_rejected": ["bronze_customers", "silver_customers"],
    "silver_accounts": ["bronze_accounts", "silver_customers"],
    "silver_accounts_rejected": ["bronze_accounts", "bronze_customers", "silver_customers"],
    "silver_transactions": ["bronze_transactions", "silver_accounts"],
    "gold_customer_360": ["silver_customers", "silver_accounts", "silver_transactions"],
    "gold_monthly_channel_volume": ["silver_transactions"],
}
OWNERS = {
    "customers": "Retail Banking — Customer Domain",
    "customers_rejected": "Retail Banking — Customer Domain (quarantine)",
    "accounts": "Retail Banking — Deposits Domain",
    "accounts_rejected": "Retail Banking — Deposits Domain (quarantine)",
    "transactions": "Payments Domain",
    "customer_360": "Customer Analytics (data product)",
    "monthly_channel_volume": "Channel Analytics (data product)",
}
UNOWNED = "Unassigned"

BRONZE = ["bronze_customers", "bronze_accounts", "bronze_transactions"]
TABLES = sorted(BRONZE + list(LINEAGE))
# Models that other models are built from: worth writing where several tables are read.
SHARED_MODELS = [name for name in LINEAGE if any(name in upstreams for upstreams in LINEAGE.values())]

Reader = Callable[[SparkSession, str], DataFrame]

# Transactions are written by month, so that a month can be read, and refreshed, alone.
BY_MONTH = {"silver_transactions": "txn_month"}
MONTH_COLUMN = {"silver_transactions": "txn_ts"}
FROM_TRANSACTIONS = ["gold_customer_360", "gold_monthly_channel_volume"]
# The moment of the run, which no profile shows.
RUN_COLUMNS = {"rejected_at"}

# What each model's write counts besides its own rows, for the checks below; `landed` is counted where bronze is read.
LANDED = {"silver_customers": "bronze_customers", "silver_accounts": "bronze_accounts", "silver_transactions": "bronze_transactions"}
MEASURES = {
    "silver_customers": {"loaded_customers": "count_if(customer_id > 0)"},
    "silver_accounts": {"silver_balance": "sum(balance)"},
    "silver_accounts_rejected": {
        "orphan_accounts": "count_if(reason_code = 'ORPHAN_CUSTOMER')",
        "upstream_accounts": "count_if(reason_code = 'CUSTOMER_REJECTED_UPSTREAM')",
        "rejected_balance": "sum(balance)",
    },
    "gold_customer_360": {"gold_balance": "sum(total_balance)"},
}
# Money may differ by this much, or by rounding of very large totals.
MONEY_TOLERANCE, ROUNDING = 0.5, 1e-9


class ConservationError(store.BuildError):
    """A build lost or invented rows or money; it is not published."""


def conservation(tables: dict[str, store.Version], measures: dict[str, float]) -> list[tuple[str, float, float, bool]]:
    """Checks of a build from what its writes counted: name, both sides, and whether they balance."""
    rows = {name: version.rows for name, version in tables.items()}
    silver, gold = (measures.get(f"{side}_balance") or 0.0 for side in ("silver", "gold"))
    rejected = measures["loaded_customers"] + rows["silver_customers_rejected"]
    return [
        ("customers", measures["landed_bronze_customers"], rejected, measures["landed_bronze_customers"] == rejected),
        ("accounts", measures["landed_bronze_accounts"], rows["silver_accounts"],
         measures["landed_bronze_accounts"] == rows["silver_accounts"]),
        ("balances", silver, gold, abs(silver - gold) < max(MONEY_TOLERANCE, ROUNDING * abs(silver))),
    ]


class Lakehouse:
    """Lazy plans of all tables over one reader of the bronze layer.

    Nothing runs until a table is used, and then only what that table needs. A model that has
    been written is read from its files, also by the sessions of scoped queries.
    """

    def __init__(self, spark: SparkSession, reader: Reader, as_of: datetime = AS_OF) -> None:
        self.spark = spark
        self.reader = reader
        self.as_of = as_of
        self._tables: dict[str, DataFrame] = {}
        self._written: dict[str, str] = {}
        self._build: store.Build | None = None
        self._folder = ""
        self._replaced: dict[str, DataFrame] = {}

    @classmethod
    def over_test_tables(cls, spark: SparkSession, folder: str) -> Lakehouse:
        return cls(spark, lambda session, name: derive(session, folder, name))

    @classmethod
    def over_folder(
        cls, spark: SparkSession, folder: str, as_of: datetime, models: str | None = None
    ) -> Lakehouse:
        """Bronze tables landed as parquet folders with their declared types, and the models as
        the last build wrote them, if their folder is given."""
        lake = cls(spark, lambda session, name: read_bronze(session, folder, name), as_of)
        return lake.reading(models) if models else lake

    def reading(self, folder: str) -> Lakehouse:
        """Read the models of the last build below a folder from here on."""
        build = store.latest(self.spark, folder)
        if build is None:
            raise FileNotFoundError(f"{folder} has no build")
        self._build, self._folder = build, folder
        self._written, self._replaced = {}, {}
        self._forget_plans()
        return self

    @classmethod
    def deployed(cls, spark: SparkSession, folder: str) -> Lakehouse:
        """The tables over the test tables, with the models of the last build if the sources are still the same.

        Without such a build every model is planned; nothing is written here.
        """
        lake = cls.over_test_tables(spark, folder)
        if not has_shared_dir(spark):
            return lake
        models = models_folder(spark, folder)
        build = store.latest(spark, models)
        if build is not None and build.sources == fingerprint(spark, folder):
            lake._build, lake._folder = build, models
        return lake

    def in_session(self, spark: SparkSession) -> Lakehouse:
        """The same tables for another session."""
        other = Lakehouse(spark, self.reader, self.as_of)
        other._written, other._build, other._folder = dict(self._written), self._build, self._folder
        return other

    def built(self, name: str) -> store.Version | None:
        """The version of a table that is read here, if a build wrote it."""
        if self._build is None or name in self._replaced or name in self._written:
            return None
        return self._build.tables.get(name)

    def month(self, name: str, month: str) -> DataFrame:
        """The rows of one month (`2001-03`); of a built table only its directory is read."""
        version = self.built(name)
        if version is not None and version.by:
            whole = store.read(self.spark, self._folder, version, with_directory=True)
            return whole.filter(F.col(version.by) == month).drop(version.by)
        return self[name].filter(month_label(F.col(MONTH_COLUMN[name])) == month)

    def row_counts(self, names: Sequence[str] = tuple(TABLES)) -> DataFrame:
        """Rows by table, as the builds counted them; only tables that no build wrote are counted here."""
        versions = {name: self.built(name) for name in names}
        known = [(name, version.rows) for name, version in versions.items() if version]
        counted = [self[name].selectExpr(f"'{name}' AS table_name", "count(*) AS n_rows") for name, v in versions.items() if not v]
        recorded = [self.spark.createDataFrame(known, "table_name STRING, n_rows BIGINT")] if known else []
        return reduce(DataFrame.unionByName, recorded + counted)

    def columns(self, names: Sequence[str] = tuple(TABLES)) -> DataFrame:
        """Columns in table order with types and how many values each holds, from the builds where they counted them."""
        known, planned = [], {}
        for name in names:
            version = self.built(name)
            if not version:
                planned[name] = self[name].drop(*RUN_COLUMNS)
                continue
            fields = [f for f in self[name].schema.fields if f.name not in RUN_COLUMNS]
            known += [(name, i, f.name, profiling.type_name(f.dataType), version.values[f.name]) for i, f in enumerate(fields, start=1)]
        schema = "table_name STRING, ordinal INT, column_name STRING, data_type STRING, n_values BIGINT"
        parts = [self.spark.createDataFrame(known, schema)] if known else []
        return reduce(DataFrame.unionByName, parts + ([profiling.column_listing(planned)] if planned else []))

    def profiles(self, names: Sequence[str] = tuple(TABLES), **options) -> DataFrame:
        """Column profiles, as the builds took them; only tables that no build wrote are profiled here."""
        versions = {name: self.built(name) for name in names}
        stored: dict[str, list[str]] = {}
        for name, version in versions.items():
            if version and version.profile:
                stored.setdefault(version.profile, []).append(name)
        held = {name for group in stored.values() for name in group}
        parts = [
            self.spark.read.schema(profiling.MEASURED).parquet(f"{self._folder}/{path}").filter(F.col("table_name").isin(group))
            for path, group in stored.items()
        ]
        fresh = {name: self[name].drop(*RUN_COLUMNS) for name in names if name not in held}
        if fresh:
            parts.append(profiling.measured(fresh))
        return profiling.presented(reduce(DataFrame.unionByName, parts), **options)

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._replaced:
            return self._replaced[name]
        if name not in self._tables:
            if name not in TABLES:
                raise KeyError(f"no table {name}")
            if name in self._written:
                self._tables[name] = self.spark.read.parquet(self._written[name])
            elif (version := self.built(name)) and version.parts:
                self._tables[name] = store.read(self.spark, self._folder, version)
            else:
                self._tables[name] = self._plan(name)
        return self._tables[name]

    def replace(self, name: str, df: DataFrame) -> None:
        """Use this DataFrame for a table of this session from now on, also in other models."""
        self._replaced[name] = df
        self._forget_plans()

    def _use_written(self, name: str, path: str) -> None:
        """Read a table from here on, also in models that were planned on the unwritten one."""
        self._written[name] = path
        self._forget_plans()

    def _forget_plans(self) -> None:
        self._tables = {n: df for n, df in self._tables.items() if n in BRONZE}

    @property
    def conformed_transactions(self) -> DataFrame:
        """Transactions for a plan that joins the accounts itself, which makes the account
        check of the silver table a second, unneeded join. A table that is there is used as it is."""
        if "silver_transactions" in {*self._written, *self._replaced} or self.built("silver_transactions"):
            return self["silver_transactions"]
        return medallion.conformed_transactions(self["bronze_transactions"], self.as_of)

    def _plan(self, name: str) -> DataFrame:
        if name in BRONZE:
            return self.reader(self.spark, name)
        if name == "silver_customers":
            return medallion.silver_customers(self["bronze_customers"])
        if name == "silver_customers_rejected":
            return medallion.silver_customers_rejected(
                self["bronze_customers"], self["silver_customers"], self.as_of
            )
        if name == "silver_accounts":
            return medallion.silver_accounts(self["bronze_accounts"], self["silver_customers"])
        if name == "silver_accounts_rejected":
            return medallion.silver_accounts_rejected(
                self["bronze_accounts"], self["bronze_customers"], self["silver_customers"], self.as_of
            )
        if name == "silver_transactions":
            return medallion.silver_transactions(
                self["bronze_transactions"], self["silver_accounts"], self.as_of
            )
        if name == "gold_customer_360":
            return medallion.gold_customer_360(
                self["silver_customers"], self["silver_accounts"], self.conformed_transactions
            )
        return medallion.gold_monthly_channel_volume(self["silver_transactions"])

    def materialise(self, names: Sequence[str] = tuple(LINEAGE)) -> None:
        """Write models to the shared folder and use the written copies from now on."""
        for name in LINEAGE:
            if name in names and name not in self._written and name not in self._replaced:
                path = scratch_path(self.spark, name)
                drop_at_exit(self.spark, path)
                self[name].write.parquet(path)
                self._use_written(name, path)

    def build(self, folder: str, sources: str | None = None) -> dict[str, DataFrame]:
        """Write all models in dependency order, check what the writes counted, take the profiles and publish.

        Each model reads the written ones before it, so a lost executor costs a re-read and not a
        recomputation of the layers below. Plans start from bronze. Readers go over to the build when it
        is published; one that fails, or that loses rows or money, leaves the one before in use.
        """
        plans = Lakehouse(self.spark, self.reader, self.as_of)
        with store.Builder(self.spark, folder, sources) as builder:
            for name in LINEAGE:
                plans.replace(name, plans._write(builder, name))
            lost = [f"{name}: {a} and {b}" for name, a, b, balanced in conservation(builder.tables, builder.measures) if not balanced]
            if lost:
                raise ConservationError("; ".join(lost))
            plans._take_profiles(builder, TABLES)
            builder.publish()
        self.reading(folder)
        return {name: self[name] for name in LINEAGE}

    def refresh_month(self, month: str, sources: str | None = None) -> None:
        """Compute the transactions of one month again, and what is made of all of them; other months stay untouched."""
        name = "silver_transactions"
        landed = self["bronze_transactions"].filter(month_label(F.col(MONTH_COLUMN[name])) == month)
        plans = Lakehouse(self.spark, self.reader, self.as_of)
        with store.Builder(self.spark, self._folder, sources or self._build.sources) as builder:
            builder.replace_directory(name, month, medallion.silver_transactions(landed, self["silver_accounts"], self.as_of))
            for model in LINEAGE:
                if model not in FROM_TRANSACTIONS:
                    plans.replace(model, store.read(self.spark, self._folder, builder.tables[model]))
            for model in FROM_TRANSACTIONS:
                plans.replace(model, plans._write(builder, model))
            plans._take_profiles(builder, ["bronze_transactions", name, *FROM_TRANSACTIONS])
            builder.publish()
        self.reading(self._folder)

    def _write(self, builder: store.Builder, name: str) -> DataFrame:
        """Write one model, counting on the way; a bronze table is counted where its first model reads it."""
        landed, watch = LANDED.get(name), Observation()
        if landed:
            self._tables[landed] = self.reader(self.spark, landed).observe(watch, F.count(F.lit(1)).alias("rows"))
        directory = BY_MONTH.get(name)
        by = month_label(F.col(MONTH_COLUMN[name])) if directory else None
        measures = {key: F.expr(text) for key, text in MEASURES.get(name, {}).items()}
        written = builder.write(name, self._plan(name), by, directory, measures)
        if landed:
            del self._tables[landed]
            count = store.observed(watch, lambda: {"rows": self[landed].count()})
            builder.measures[f"landed_{landed}"] = count["rows"]
        return written

    def _take_profiles(self, builder: store.Builder, names: Sequence[str]) -> None:
        """Profile tables as written, and bronze as landed, which has no files here but counts as well."""
        part = builder.new_part("_profiles")
        path = f"{builder.folder}/{part}"
        profiling.measured({name: self[name].drop(*RUN_COLUMNS) for name in names}).coalesce(1).write.parquet(path)
        landed = [name for name in names if name in BRONZE]
        counts = self.spark.read.schema(profiling.MEASURED).parquet(path).filter(F.col("table_name").isin(landed))
        for row in counts.groupBy("table_name").agg(
            F.max("row_count").alias("rows"), F.map_from_entries(F.collect_list(F.struct("column_name", F.expr("row_count - null_count")))).alias("values")
        ).collect():
            builder.tables[row["table_name"]] = store.Version([], self[row["table_name"]].schema.json(), row["rows"], row["values"])
        builder.profiled(names, part)


def models_folder(spark: SparkSession, folder: str) -> str:
    """Where this application keeps the models over a folder of test tables."""
    digest = hashlib.sha256(folder.encode()).hexdigest()[:16]
    return f"{shared_dir(spark)}/touchstone-models/{spark.sparkContext.applicationId}/{digest}"


def fingerprint(spark: SparkSession, folder: str) -> str:
    """What the source files look like: a build on other files is out of date."""
    seen = []
    for table, _ in SOURCES.values():
        files, path = store.file_system(spark, f"{folder}/{table}.parquet")
        content = files.getContentSummary(path)
        seen.append(f"{table}:{content.getLength()}:{content.getFileCount()}:{files.getFileStatus(path).getModificationTime()}")
    return " ".join(seen)


def deploy(spark: SparkSession, folder: str) -> Lakehouse:
    """Build the models over the test tables anew, for `Lakehouse.deployed` to read."""
    lake, models = Lakehouse.over_test_tables(spark, folder), models_folder(spark, folder)
    drop_at_exit(spark, models)
    lake.build(models, fingerprint(spark, folder))
    return lake
