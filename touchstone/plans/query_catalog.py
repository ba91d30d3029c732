"""Queries: profiles, masking, catalog cards, metadata and lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.operators import profiling
from touchstone.plans.lakehouse import BRONZE, LINEAGE, OWNERS, TABLES, UNOWNED, Lakehouse
from touchstone.plans.oracles import CTES
from touchstone.plans.registry import over_deployed, over_tables
from touchstone.sources.contracts import load_contract, personal_names
from touchstone.sources.derived import EXPRESSIONS

# The columns that contracts call personal; tables without a contract have the usual ones.
CONTRACTED = {"silver_customers": personal_names(load_contract("silver_customers"))}

# Column types of the tables, spelled as DuckDB and the contracts spell them.
COLUMN_TYPES = {
    "bronze_customers": "BIGINT VARCHAR VARCHAR VARCHAR DATE VARCHAR VARCHAR INTEGER DATE",
    "bronze_accounts": "BIGINT BIGINT VARCHAR DOUBLE VARCHAR DATE VARCHAR",
    "bronze_transactions": "BIGINT BIGINT DOUBLE VARCHAR TIMESTAMP VARCHAR INTEGER",
}
SCHEMAS = {
    name: list(zip(EXPRESSIONS[name], types.split(), strict=True)) for name, types in COLUMN_TYPES.items()
}
SCHEMAS |= {f"silver_{n}": SCHEMAS[f"bronze_{n}"] for n in ["customers", "accounts", "transactions"]}
REJECTION = [("reason_code", "VARCHAR"), ("rejected_by", "VARCHAR")]
SCHEMAS |= {f"silver_{n}_rejected": SCHEMAS[f"bronze_{n}"] + REJECTION for n in ["customers", "accounts"]}
SCHEMAS["gold_customer_360"] = [
    *[c for c in SCHEMAS["silver_customers"] if c[0] not in ("email", "date_of_birth", "created_at")],
    ("n_accounts", "BIGINT"),
    ("total_balance", "DOUBLE"),
    ("n_txns", "BIGINT"),
    ("n_large_txns", "BIGINT"),
]
SCHEMAS["gold_monthly_channel_volume"] = [
    ("month", "TIMESTAMP"),
    ("channel", "VARCHAR"),
    ("n_txns", "BIGINT"),
    ("gross_value", "DOUBLE"),
]


def tables(lake: Lakehouse, names: list[str]) -> dict[str, DataFrame]:
    """Tables without the time of rejection, which is the run's own moment."""
    return {name: lake[name].drop("rejected_at") for name in names}


def _hidden(value: str) -> str:
    return (
        f"CASE WHEN {value} IS NULL THEN NULL WHEN position('@' IN {value}) > 0 THEN "
        f"left(split_part({value}, '@', 1), 1) || '***@' || {value}[position('@' IN {value}) + 1:] "
        f"WHEN length({value}) <= 1 THEN '*' ELSE left({value}, 1) || repeat('*', length({value}) - 1) END"
    )


def profile_oracle(table: str, masked: bool = True, relation: str | None = None, more: tuple[str, ...] = ()) -> str:
    """One SELECT per column; the oracle reads the table as often as it likes."""
    relation = relation or table
    selects = []
    for i, (column, kind) in enumerate(SCHEMAS[table], start=1):
        number = kind in ("BIGINT", "INTEGER", "DOUBLE")
        ranged = number or kind in ("DATE", "TIMESTAMP")
        personal = column in profiling.PERSONAL or column in more
        hide = _hidden if personal and masked else (lambda v: v)
        low = f"(SELECT CAST(min({column}) AS VARCHAR) FROM {relation})" if ranged else "CAST(NULL AS VARCHAR)"
        high = f"(SELECT CAST(max({column}) AS VARCHAR) FROM {relation})" if ranged else "CAST(NULL AS VARCHAR)"
        values = f"SELECT DISTINCT {column} AS v FROM {relation} WHERE {column} IS NOT NULL ORDER BY v LIMIT 5"
        text = "CAST(v AS VARCHAR)"
        selects.append(
            f"SELECT '{table}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{column}' AS column_name, "
            f"'{kind}' AS data_type, count(*) AS row_count, count(*) - count({column}) AS null_count, "
            f"100.0 * CAST(count(*) - count({column}) AS DOUBLE) / greatest(count(*), 1) AS null_pct, "
            f"count(DISTINCT {column}) AS distinct_count, "
            f"100.0 * CAST(count(DISTINCT {column}) AS DOUBLE) / greatest(count(*), 1) AS distinct_pct, "
            f"{hide(low)} AS min_text, {hide(high)} AS max_text, "
            + (
                f"CAST(min({column}) AS DOUBLE) AS min_number, CAST(max({column}) AS DOUBLE) AS max_number, "
                f"avg({column}) AS mean, stddev_samp({column}) AS stddev, "
                if number
                else "CAST(NULL AS DOUBLE) AS min_number, CAST(NULL AS DOUBLE) AS max_number, "
                "CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS stddev, "
            )
            + f"(SELECT coalesce(string_agg({hide(text)}, ', ' ORDER BY v), '') FROM ({values})) AS samples, "
            f"{str(personal).lower()} AS is_personal FROM {relation}"
        )
    return " UNION ALL ".join(selects)


def rounded_profile(rows: DataFrame) -> DataFrame:
    """A profile in plain columns, rounded where the order of a float sum shows."""
    return rows.select(
        "table_name", "ordinal", "column_name", "data_type", "row_count", "null_count",
        F.round("null_pct", 4).alias("null_pct"),
        "distinct_count",
        F.round("distinct_pct", 4).alias("distinct_pct"),
        "min_text", "max_text", "min_number", "max_number",
        F.round("mean", 4).alias("mean"),
        F.round("stddev", 4).alias("stddev"),
        F.concat_ws(", ", "samples").alias("samples"),
        "is_personal",
    )


ROUNDED = (
    "* REPLACE (round(null_pct, 4) AS null_pct, round(distinct_pct, 4) AS distinct_pct, "
    "round(mean, 4) AS mean, round(stddev, 4) AS stddev)"
)
FAMILIES = {"numeric": "'BIGINT', 'INTEGER', 'DOUBLE'", "temporal": "'DATE', 'TIMESTAMP'", "other": "'VARCHAR'"}

for _table in TABLES:
    CTES[f"profile_of_{_table}"] = profile_oracle(_table)
CTES["bronze_profile"] = " UNION ALL ".join(f"SELECT * FROM profile_of_{t}" for t in sorted(BRONZE))
CTES["whole_profile"] = " UNION ALL ".join(f"SELECT * FROM profile_of_{t}" for t in TABLES)


def _landed_profile(lake: Lakehouse, family: str) -> DataFrame:
    """Only columns of one family are read, so the others are pruned from the scan."""

    def wanted(df: DataFrame) -> DataFrame:
        return df.select(*[f.name for f in df.schema.fields if profiling.family(f.dataType) == family])

    return rounded_profile(profiling.profiles({n: wanted(df) for n, df in tables(lake, sorted(BRONZE)).items()}))


NUMERIC_COLUMNS = "table_name, column_name, data_type, row_count, null_count, null_pct, distinct_count, distinct_pct"
for _family, _key, _more in [
    ("numeric", "profile_numeric", ["min_number", "max_number", "mean", "stddev"]),
    ("temporal", "profile_temporal", ["min_text", "max_text"]),
    ("other", "profile_string", ["min_text", "max_text"]),
]:
    _columns = NUMERIC_COLUMNS.split(", ") + _more
    over_tables(
        _key,
        f"SELECT {', '.join(_columns)} FROM (SELECT {ROUNDED} FROM bronze_profile) "
        f"WHERE data_type IN ({FAMILIES[_family]})",
    )(lambda lake, f=_family, c=_columns: _landed_profile(lake, f).select(*c))


@over_tables(
    "profile_samples",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(row_number() OVER (ORDER BY v) AS INTEGER) AS rank, "
        f"CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL ORDER BY v LIMIT 5)"
        for t in sorted(BRONZE)
        for c, _ in SCHEMAS[t]
    ),
)
def _samples(lake: Lakehouse) -> DataFrame:
    landed = {name: lake[name] for name in sorted(BRONZE)}
    position = F.create_map(
        *[F.lit(part) for name, df in landed.items() for part in (name, ",".join(df.columns))]
    )
    column = F.element_at(F.split(F.element_at(position, F.col("table_name")), ","), F.col("ordinal"))
    return profiling.smallest_values(profiling.distinct_values(landed), list(landed)).select(
        "table_name", column.alias("column_name"), "rank", "value"
    )


def with_city(contract: dict) -> dict:
    """A proposed contract that calls the city personal, too."""
    columns = [{**column, "pii": column["pii"] or column["name"] == "city"} for column in contract["schema"]]
    return {**contract, "schema": columns}


over_tables(
    "profile_by_contract",
    f"SELECT {ROUNDED} FROM ({profile_oracle('silver_customers', more=('city',))})",
)(
    lambda lake: rounded_profile(
        profiling.profile(
            lake["silver_customers"], "silver_customers", personal=personal_names(with_city(load_contract("silver_customers")))
        )
    )
)


@over_tables(
    "mask_pii",
    "SELECT customer_id, "
    + ", ".join(
        f"{_hidden(f'CAST({c} AS VARCHAR)' if c == 'date_of_birth' else c)} AS {c}" for c in profiling.PERSONAL
    )
    + ", city FROM silver_customers",
)
def _mask_pii(lake: Lakehouse) -> DataFrame:
    return profiling.hide_personal(lake["silver_customers"]).select("customer_id", *profiling.PERSONAL, "city")


over_tables(
    "summarize_table",
    f"SELECT {ROUNDED} FROM profile_of_bronze_transactions",
)(lambda lake: rounded_profile(profiling.profile(lake["bronze_transactions"], "bronze_transactions")))


over_deployed("catalog_profile", f"SELECT {ROUNDED} FROM whole_profile")(
    lambda lake: rounded_profile(lake.profiles(personal=CONTRACTED))
)


def _owner_case() -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OWNERS.items())
    return f"CASE substr(table_name, position('_' IN table_name) + 1) {whens} ELSE '{UNOWNED}' END"


def _upstream_case() -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{', '.join(v)}'" for k, v in LINEAGE.items())
    return f"CASE table_name {whens} ELSE '' END"


CTES["whole_catalog"] = (
    f"SELECT table_name, split_part(table_name, '_', 1) AS layer, {_owner_case()} AS owner, row_count, "
    f"{_upstream_case()} AS upstreams, count(*) AS n_columns, "
    "CAST(sum(null_count) AS BIGINT) AS n_nulls, string_agg('| ' || concat_ws(' | ', column_name, data_type, "
    "printf('%.1f%%', null_pct), CAST(distinct_count AS VARCHAR), CASE WHEN is_personal THEN 'yes' ELSE '' END, "
    "coalesce(min_text, 'None'), coalesce(max_text, 'None'), samples) || ' |', chr(10) ORDER BY ordinal) AS lines "
    "FROM whole_profile GROUP BY table_name, row_count"
)


def whole_catalog(lake: Lakehouse, **options) -> DataFrame:
    return profiling.catalog(lake.profiles(**{"personal": CONTRACTED, **options}), TABLES, LINEAGE, OWNERS, UNOWNED)


over_deployed(
    "table_profile", "SELECT table_name, layer, owner, row_count, upstreams, n_columns, n_nulls FROM whole_catalog"
)(
    lambda lake: whole_catalog(lake).select(
        "table_name",
        "layer",
        "owner",
        "row_count",
        F.concat_ws(", ", "upstreams").alias("upstreams"),
        F.size("columns").cast("bigint").alias("n_columns"),
        F.aggregate("columns", F.lit(0).cast("bigint"), lambda n, c: n + c["null_count"]).alias("n_nulls"),
    )
)

CTES["catalog_texts"] = (
    "SELECT table_name, '# Table: ' || table_name || chr(10) || '- Medallion layer: **' || layer || '**' || chr(10) || "
    "'- Business domain / owner: ' || owner || chr(10) || '- Row count: ' || format('{:,}', row_count) || chr(10) || "
    "'- Upstream tables (lineage): ' || CASE WHEN upstreams = '' THEN '— (raw landing)' ELSE upstreams END || chr(10) || "
    f"chr(10) || '## Columns' || chr(10) || '{profiling.CARD_COLUMNS}' || chr(10) || '{profiling.CARD_RULE}' || chr(10) || "
    "lines AS card FROM whole_catalog"
)

over_deployed("catalog_cards", "SELECT * FROM catalog_texts")(lambda lake: profiling.cards(whole_catalog(lake)))

COLUMN_FIELDS = (
    "column_name: STRING, data_type: STRING, null_count: BIGINT, distinct_count: BIGINT, min_text: STRING, max_text: STRING, "
    "samples: ARRAY<STRING>, is_personal: BOOLEAN"
)
FIELDS = (
    "table_name STRING, layer STRING, owner STRING, row_count BIGINT, upstreams ARRAY<STRING>, "
    f"columns ARRAY<STRUCT<{COLUMN_FIELDS}>>"
)


@over_deployed(
    "catalog_json",
    "SELECT c.table_name, layer, owner, c.row_count, upstreams, n_columns, ordinal - 1 AS position, column_name, data_type, "
    "null_count, distinct_count, min_text, max_text, samples, is_personal FROM whole_catalog c JOIN whole_profile USING (table_name)",
)
def _json(lake: Lakehouse) -> DataFrame:
    """The catalog as JSON documents, and what a reader of the documents finds in them."""
    written = whole_catalog(lake).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))
    entry = written.select(F.from_json("document", FIELDS).alias("d")).select("d.*")
    return entry.select("*", F.posexplode("columns").alias("position", "c")).select(
        "table_name", "layer", "owner", "row_count", F.concat_ws(", ", "upstreams").alias("upstreams"),
        F.size("columns").cast("bigint").alias("n_columns"), "position",
        *[F.col(f"c.{n}").alias(n) for n in ("column_name", "data_type", "null_count", "distinct_count", "min_text", "max_text")],
        F.concat_ws(", ", "c.samples").alias("samples"), F.col("c.is_personal").alias("is_personal"),
    )


over_deployed(
    "catalog_columns",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, "
        f"coalesce(any_value(typeof({c})), '{k}') AS data_type, count({c}) AS n_values FROM {t}"
        for t in TABLES
        for i, (c, k) in enumerate(SCHEMAS[t], start=1)
    ),
)(lambda lake: lake.columns())


@over_deployed(
    "lineage_direct",
    " UNION ALL ".join(
        [
            f"SELECT '{t}' AS table_name, '{u}' AS upstream, (SELECT count(*) FROM {t}) AS n_rows, "
            f"(SELECT count(*) FROM {u}) AS n_upstream_rows"
            for t, ups in LINEAGE.items()
            for u in ups
        ]
        + [f"SELECT '{t}', NULL, (SELECT count(*) FROM {t}), NULL" for t in BRONZE]
    ),
)
def _lineage(lake: Lakehouse) -> DataFrame:
    return profiling.lineage_edges(lake.row_counts(), LINEAGE)
