"""What a proposed contract changes, how serious that is, and the version it leads to.

Works on contract tables: one row per contract and column, rule or header. Old and new sides
meet in one full outer join on contract and name, whatever the number of contracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchstone.session import materialise
from touchstone.sources import store, tables

ADDITIVE, BREAKING, METADATA = "additive", "breaking", "metadata"
COLUMN_FIELDS = ["type", "nullable", "pii", "description"]
RULE_FIELDS = ["severity", "assertion"]
# The header fields whose change counts, with their paths.
HEADER_PATHS = {
    "domain": "metadata.domain",
    "owner": "metadata.owner",
    "description": "description",
    "freshness": "semantics.freshness",
}
# Parts of a contract that a diff does not look at.
IGNORED_PARTS = ["profile_expectations", "lineage", "consumer_guarantees", "semantics.grain", "semantics.primary_key"]


def _paired(old: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select("contract_id", "name", F.struct(*fields).alias(name))

    return side(old, "_old").join(side(new, "_new"), ["contract_id", "name"], "full_outer")


def _kind() -> Column:
    return (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("modified")
    )


def _changes(paired: DataFrame, prefix: str, classification: Column) -> DataFrame:
    return paired.filter(~F.col("_old").eqNullSafe(F.col("_new"))).select(
        "contract_id",
        F.concat(F.lit(prefix), F.col("name")).alias("path"),
        _kind().alias("kind"),
        classification.alias("classification"),
        F.to_json("_old").alias("old"),
        F.to_json("_new").alias("new"),
    )


def column_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    was, now = F.col("_old"), F.col("_new")
    optional = F.coalesce(now["nullable"], F.lit(True))  # a column may be null unless declared otherwise
    added = F.when(optional, ADDITIVE).otherwise(BREAKING)
    modified = (
        F.when(~was["type"].eqNullSafe(now["type"]), BREAKING)
        .when(was["nullable"] & ~now["nullable"], BREAKING)
        .when(~was["nullable"] & now["nullable"], ADDITIVE)
        .when(~was["pii"].eqNullSafe(now["pii"]), BREAKING)
        .otherwise(METADATA)
    )
    classification = F.when(was.isNull(), added).when(now.isNull(), BREAKING).otherwise(modified)
    return _changes(_paired(old, new, COLUMN_FIELDS), "schema.", classification)


def rule_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    classification = F.when(F.col("_old").isNull(), ADDITIVE).otherwise(BREAKING)
    return _changes(_paired(old, new, RULE_FIELDS), "quality_rules.", classification)


def header_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changed header fields; a contract that one side lacks has none there, so all its fields changed."""
    was = old.select("contract_id", *[F.col(f).alias(f"_old_{f}") for f in HEADER_PATHS])
    now = new.select("contract_id", *[F.col(f).alias(f"_new_{f}") for f in HEADER_PATHS])
    fields = F.array(
        *[
            F.struct(
                F.lit(path).alias("path"), F.col(f"_old_{field}").alias("old"), F.col(f"_new_{field}").alias("new")
            )
            for field, path in HEADER_PATHS.items()
        ]
    )
    return (
        was.join(now, "contract_id", "full_outer")
        .select("contract_id", F.inline(fields))
        .filter(~F.col("old").eqNullSafe(F.col("new")))
        .select(
            "contract_id",
            "path",
            F.lit("modified").alias("kind"),
            F.lit(METADATA).alias("classification"),
            "old",
            "new",
        )
    )


# What a contract without a baseline starts from.
FIRST_VERSION = "0.0.0"


def summary(headers: DataFrame, changes: DataFrame, new_headers: DataFrame | None = None) -> DataFrame:
    """Changes per class for every contract, zero where there are none.

    `headers` are those of the baseline. With the proposed ones, contracts that only they have are listed too.
    """
    if new_headers is not None:
        first = new_headers.join(headers, "contract_id", "left_anti").select("contract_id", F.lit(FIRST_VERSION).alias("version"))
        headers = headers.select("contract_id", "version").unionByName(first)
    counted = changes.groupBy("contract_id").agg(
        *[F.count_if(F.col("classification") == c).alias(c) for c in (ADDITIVE, BREAKING, METADATA)]
    )
    none = F.lit(0).cast("bigint")
    return headers.select("contract_id", "version").join(counted, "contract_id", "left").select(
        "contract_id", "version", *[F.coalesce(c, none).alias(c) for c in (ADDITIVE, BREAKING, METADATA)]
    )


def bumped(version: Column, level: Column) -> Column:
    major, minor, patch = (F.split(version, "[.]")[i].cast("int") for i in range(3))
    return (
        F.when(level == "major", F.concat_ws(".", (major + 1).cast("string"), F.lit("0.0")))
        .when(level == "minor", F.concat_ws(".", major.cast("string"), (minor + 1).cast("string"), F.lit("0")))
        .otherwise(F.concat_ws(".", major.cast("string"), minor.cast("string"), (patch + 1).cast("string")))
    )


def next_versions(summaries: DataFrame) -> DataFrame:
    level = F.when(F.col(BREAKING) > 0, "major").when(F.col(ADDITIVE) > 0, "minor").otherwise("patch")
    return summaries.withColumn("level", level).withColumn(
        "next_version", bumped(F.col("version"), F.col("level"))
    )


def promoted(new_headers: DataFrame, versions: DataFrame) -> DataFrame:
    """The proposed headers under the versions that the baseline and the changes lead to."""
    return new_headers.drop("version").join(
        versions.select("contract_id", F.col("next_version").alias("version")), "contract_id"
    )


def history(headers: DataFrame, versions: DataFrame) -> DataFrame:
    """The change log of every contract after promotion, newest entry first."""
    note = F.concat_ws(
        ", ", *[F.concat(F.col(c).cast("string"), F.lit(f" {c}")) for c in (ADDITIVE, BREAKING, METADATA)]
    )
    entry = F.struct(F.col("next_version").alias("version"), note.alias("note"))
    logs = versions.select("contract_id", entry.alias("_entry")).join(
        headers.select("contract_id", "change_log"), "contract_id", "left"
    )
    earlier = F.coalesce("change_log", F.array().cast("array<struct<version:string,note:string>>"))
    entries = F.concat(F.array("_entry"), earlier)
    return logs.select("contract_id", F.posexplode(entries).alias("position", "entry")).select(
        "contract_id", "position", "entry.version", "entry.note"
    )


def _column_form(document: Column) -> Column:
    """A column as its type, with NOT NULL and PII where they apply."""
    column = F.from_json(document, "type STRING, nullable BOOLEAN, pii BOOLEAN")
    return F.concat(
        column["type"],
        F.when(~F.coalesce(column["nullable"], F.lit(True)), " NOT NULL").otherwise(""),
        F.when(column["pii"], " PII").otherwise(""),
    )


def _rule_form(document: Column) -> Column:
    rule = F.from_json(document, "severity STRING, assertion STRING")
    return F.concat(F.coalesce(rule["severity"], F.lit("?")), F.lit(": `"), rule["assertion"], F.lit("`"))


# The head of the report, and what it says if nothing changed.
REPORT_HEAD = ["| path | kind | classification | change |", "|---|---|---|---|"]
NO_CHANGES = "No changes."


def document(changes: DataFrame, contract_id: str) -> DataFrame:
    """The whole report of one contract: parts a diff does not look at, a head, and the changes by path."""
    lines = report(changes.filter(F.col("contract_id") == contract_id))
    unseen = f"Not compared: {', '.join(IGNORED_PARTS)}."
    return tables.document(lines, ["path"], "line", [f"# {contract_id}", "", unseen, "", *REPORT_HEAD], NO_CHANGES)


def promote(folder: str, old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """Write the proposed headers under their new versions, and the change logs, as one build; returns the headers
    as written. A contract that is no longer proposed keeps its log and has no header. Both tables need the versions,
    which are one small row per contract and take comparing all columns and rules, so they are written in between."""
    versions = materialise(next_versions(summary(old, changes, new)), "versions")
    with store.Builder(old.sparkSession, folder) as builder:
        builder.write("contract_history", history(old, versions))
        written = builder.write("contract_headers", promoted(new, versions))
        builder.publish()
    return written


def report(changes: DataFrame) -> DataFrame:
    """A Markdown table line per change, old form to new form."""

    def form(document: str) -> Column:
        short = (
            F.when(F.col("path").startswith("schema."), _column_form(F.col(document)))
            .when(F.col("path").startswith("quality_rules."), _rule_form(F.col(document)))
            .otherwise(F.col(document))
        )
        return F.coalesce(short, F.lit("None"))

    line = F.format_string("| %s | %s | **%s** | %s → %s |", "path", "kind", "classification", form("old"), form("new"))
    return changes.select("contract_id", "path", line.alias("line"))
