"""Column profiles, catalog cards and table metadata.

A table is profiled in two reads. One plain aggregate gives counts, ranges and moments of all
columns. The other turns the table into (column, value) pairs and counts the distinct ones,
which combines equal values in every task; exact distinct counts of many columns in one
aggregate would copy every row once per column in full width. The pairs of all tables go
through one shuffle.

Expressions that repeat per column are SQL text: a schema may have hundreds of columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    LongType,
    NumericType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

from touchstone.functions.text import masked

# The function that holds samples travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLES = 5

# Columns treated as personal where no contract says so, and how types are named.
PERSONAL = ["first_name", "last_name", "email", "date_of_birth"]
TYPE_NAMES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "float": "FLOAT",
    "date": "DATE",
    "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP",
    "boolean": "BOOLEAN",
}


def type_name(data_type: DataType) -> str:
    """The type as contracts spell it."""
    simple = data_type.simpleString()
    return TYPE_NAMES.get(simple, simple.upper())


def is_numeric(data_type: DataType) -> bool:
    return isinstance(data_type, NumericType)


def is_temporal(data_type: DataType) -> bool:
    return isinstance(data_type, DateType | TimestampType | TimestampNTZType)


def as_text(column: str, data_type: DataType) -> str:
    """SQL for a value as text; a double never gets an exponent."""
    if not isinstance(data_type, DoubleType | FloatType):
        return f"CAST({column} AS STRING)"
    text = f"CAST(CAST({column} AS DOUBLE) AS STRING)"
    sign = f"CASE WHEN startswith({text}, '-') THEN '-' ELSE '' END"
    digits = f"regexp_replace(regexp_replace(substring_index({text}, 'E', 1), '[-.]', ''), '0+$', '')"
    power = f"CAST(substring_index({text}, 'E', -1) AS INT)"
    small = f"concat({sign}, '0.', repeat('0', -{power} - 1), {digits})"
    large = (
        f"concat({sign}, left(rpad({digits}, {power} + 1, '0'), {power} + 1), '.', "
        f"CASE WHEN length({digits}) > {power} + 1 THEN substring({digits}, {power} + 2) ELSE '0' END)"
    )
    return f"CASE WHEN NOT contains({text}, 'E') THEN {text} WHEN {power} < 0 THEN {small} ELSE {large} END"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _inlined(rows: Sequence[str]) -> str:
    return f"inline(array({', '.join(rows)}))"


def _statistics(df: DataFrame, table: str) -> DataFrame:
    """One row per column: counts, range and moments, from one aggregate over the table."""
    measures = ["count(*) AS _rows"]
    rows = []
    for i, field in enumerate(df.schema.fields, start=1):
        column, kind = _quoted(field.name), field.dataType
        measures.append(f"count({column}) AS _filled_{i}")
        low = high = "CAST(NULL AS STRING)"
        low_number = high_number = mean = deviation = "CAST(NULL AS DOUBLE)"
        if is_numeric(kind) or is_temporal(kind):
            measures += [f"min({column}) AS _min_{i}", f"max({column}) AS _max_{i}"]
            low, high = as_text(f"_min_{i}", kind), as_text(f"_max_{i}", kind)
        if is_numeric(kind):
            measures += [f"avg({column}) AS _mean_{i}", f"stddev_samp({column}) AS _sd_{i}"]
            low_number, high_number = f"CAST(_min_{i} AS DOUBLE)", f"CAST(_max_{i} AS DOUBLE)"
            mean, deviation = f"CAST(_mean_{i} AS DOUBLE)", f"_sd_{i}"
        rows.append(
            f"named_struct('table_name', '{table}', 'ordinal', {i}, 'column_name', {_literal(field.name)}, "
            f"'data_type', '{type_name(kind)}', 'row_count', _rows, 'null_count', _rows - _filled_{i}, "
            f"'min_text', {low}, 'max_text', {high}, 'min_number', {low_number}, 'max_number', {high_number}, "
            f"'mean', {mean}, 'stddev', {deviation})"
        )
    return df.selectExpr(*measures).selectExpr(_inlined(rows))


def family(data_type: DataType) -> str:
    if is_numeric(data_type):
        return "numeric"
    return "temporal" if is_temporal(data_type) else "other"


def distinct_values(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Distinct values of every column of the tables.

    Numbers stay numbers, in `whole` or `real`, and other types are in `text`: fixed-width keys
    are cheaper to hash and shuffle, and sort as numbers do. A decimal is in `text`, all its digits,
    and in `real`, to sort by.
    """

    def cells(position: int, df: DataFrame) -> DataFrame:
        rows = []
        for i, field in enumerate(df.schema.fields, start=1):
            column, kind = _quoted(field.name), field.dataType
            value = dict.fromkeys(["whole", "real", "text"], "NULL")
            if isinstance(kind, IntegralType):
                value["whole"] = column
            elif isinstance(kind, DoubleType | FloatType):
                value["real"] = column
            elif isinstance(kind, DecimalType):
                value["real"] = value["text"] = column
            else:
                value["text"] = column
            rows.append(
                f"named_struct('place', {position}, 'ordinal', {i}, 'whole', CAST({value['whole']} AS BIGINT), "
                f"'real', CAST({value['real']} AS DOUBLE), 'text', CAST({value['text']} AS STRING))"
            )
        return df.selectExpr(_inlined(rows))

    every = reduce(DataFrame.union, [cells(position, df) for position, df in enumerate(tables.values())])
    return every.filter("whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL").distinct()


def _smallest(size: int, counted: bool = False):
    """For mapInArrow: the `size` smallest values of each column among a task's rows.

    With `counted`, rows have one more field, `n`, and a row for each column says how many values the task has seen.
    Values beyond the last one held of a full column are left out at once, so few of them are sorted.
    """
    order = [(name, "ascending") for name in ("whole", "real", "text")]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], pa.Table] = {}
        last: dict[tuple[int, int], list] = {}
        seen: dict[tuple[int, int], int] = {}
        schema = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            schema = rows.schema
            columns = rows.select(["place", "ordinal"]).combine_chunks()
            codes = pc.add(pc.multiply(columns["place"].cast(pa.int64()), 1 << 32), columns["ordinal"].cast(pa.int64()))
            encoded = pc.dictionary_encode(codes).combine_chunks()
            keys = [(code >> 32, code & 0xFFFFFFFF) for code in encoded.dictionary.to_pylist()]
            for entry in pc.value_counts(encoded.indices).to_pylist():
                seen[keys[entry["values"]]] = seen.get(keys[entry["values"]], 0) + entry["counts"]
            bounds = [last.get(key, [None, None, None]) for key in keys]
            above = [
                pc.greater(rows[name], pa.array([bound[i] for bound in bounds], rows.schema.field(name).type).take(encoded.indices))
                for i, (name, _) in enumerate(order)
            ]
            # A decimal has a text, too, which does not sort as it does.
            above[2] = pc.and_(above[2], pc.and_(pc.is_null(rows["whole"]), pc.is_null(rows["real"])))
            beyond = reduce(pc.or_, [pc.fill_null(one, False) for one in above])
            near = rows.filter(pc.invert(beyond))
            for column in near.group_by(["place", "ordinal"]).aggregate([]).to_pylist():
                key = column["place"], column["ordinal"]
                own = near.filter((pc.field("place") == key[0]) & (pc.field("ordinal") == key[1]))
                both = pa.concat_tables([held[key], own]) if key in held else own
                held[key] = both.take(pc.sort_indices(both, order)[:size])
                if held[key].num_rows == size:
                    last[key] = [held[key][name][size - 1].as_py() for name, _ in order]
        for key, table in held.items():
            if not counted:
                yield from table.combine_chunks().to_batches()
                continue
            none = [pa.nulls(table.num_rows, pa.int64())]
            yield from table.append_column("n", none).combine_chunks().to_batches()
            total = {"place": [key[0]], "ordinal": [key[1]], "whole": [None], "real": [None], "text": [None], "n": [seen[key]]}
            yield pa.RecordBatch.from_pydict(total, schema.append(pa.field("n", pa.int64())))

    return keep


def _value() -> str:
    return f"coalesce(text, CAST(whole AS STRING), {as_text('real', DoubleType())}) AS value"


def smallest_values(values: DataFrame, tables: Sequence[str], size: int = SAMPLES) -> DataFrame:
    """The smallest distinct values of every column as text, with their rank.

    A task holds `size` values of every column while it goes through its rows, one Arrow batch at a time.
    """
    order = Window.partitionBy("place", "ordinal").orderBy("whole", "real", "text")
    few = values.mapInArrow(_smallest(size), values.schema)
    ranked = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    return ranked.selectExpr(_place(tables), "ordinal", "rank", _value())


def _place(tables: Sequence[str]) -> str:
    names = ", ".join(f"'{name}'" for name in tables)
    return f"element_at(array({names}), place + 1) AS table_name"


def _exact(tables: Mapping[str, DataFrame]) -> DataFrame:
    """How many distinct values every column has, and the smallest ones, from one pass over the distinct values.

    A task adds one count and SAMPLES values of every column, so the windows see few rows.
    """
    values = distinct_values(tables)
    few = values.mapInArrow(_smallest(SAMPLES, counted=True), StructType([*values.schema.fields, StructField("n", LongType())]))
    column = Window.partitionBy("place", "ordinal")
    ranked = few.withColumns(
        {"rank": F.row_number().over(column.orderBy("n", "whole", "real", "text")), "distinct_count": F.sum("n").over(column)}
    )
    return ranked.filter((F.col("rank") <= SAMPLES) & F.col("n").isNull()).selectExpr(
        _place(list(tables)), "ordinal", "distinct_count", "rank", _value()
    )


def _estimated(table: str, df: DataFrame) -> DataFrame:
    names = [f"approx_count_distinct({_quoted(c)}) AS _{i}" for i, c in enumerate(df.columns, start=1)]
    rows = [
        f"named_struct('table_name', '{table}', 'ordinal', {i}, 'distinct_count', _{i}, "
        "'rank', CAST(NULL AS INT), 'value', CAST(NULL AS STRING))"
        for i in range(1, len(names) + 1)
    ]
    return df.selectExpr(*names).selectExpr(_inlined(rows))


MEASURES = "column_name data_type row_count null_count distinct_count min_text max_text min_number max_number mean stddev"
#: What `measured` returns, and what is stored next to written tables.
MEASURED = (
    "table_name STRING, ordinal INT, column_name STRING, data_type STRING, row_count BIGINT, null_count BIGINT, "
    "distinct_count BIGINT, min_text STRING, max_text STRING, min_number DOUBLE, max_number DOUBLE, mean DOUBLE, "
    "stddev DOUBLE, samples ARRAY<STRING>"
)


def measured(tables: Mapping[str, DataFrame], exact: bool = True) -> DataFrame:
    """One row per column of the tables: what was counted, unmasked."""
    parts = [_statistics(df, table) for table, df in tables.items()]
    parts += [_exact(tables)] if exact else [_estimated(table, df) for table, df in tables.items()]
    return (
        reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        .groupBy("table_name", "ordinal")
        .agg(
            *[F.max(name).alias(name) for name in MEASURES.split()],
            # At most SAMPLES entries: only the smallest values carry a rank.
            F.expr("transform(array_sort(collect_list(CASE WHEN rank IS NOT NULL THEN struct(rank, value) END)), "
                   "s -> s.value)").alias("samples"),
        )
        .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint")))
    )


def presented(rows: DataFrame, personal: Sequence[str] | Mapping[str, Sequence[str]] = PERSONAL, mask: bool = True) -> DataFrame:
    """Measured columns with percentages, and values of personal columns masked unless asked not to.

    `personal` names columns of all tables, or by table those of some and PERSONAL for the others.
    """

    def listed(names: Sequence[str]) -> str:
        quoted = ", ".join(_literal(name) for name in names)
        return f"column_name IN ({quoted})" if quoted else "false"

    is_personal = listed(personal) if not isinstance(personal, Mapping) else "CASE table_name " + " ".join(
        f"WHEN {_literal(table)} THEN {listed(names)}" for table, names in personal.items()
    ) + f" ELSE {listed(PERSONAL)} END"
    return rows.selectExpr(
        "table_name", "ordinal", "column_name", "data_type", "row_count", "null_count",
        "100.0D * null_count / greatest(row_count, 1) AS null_pct",
        "distinct_count",
        "100.0D * distinct_count / greatest(row_count, 1) AS distinct_pct",
        "min_text", "max_text", "min_number", "max_number", "mean", "stddev", "samples",
        f"{is_personal} AS is_personal",
    ).transform(_hide if mask else lambda df: df)


def profiles(
    tables: Mapping[str, DataFrame],
    *,
    personal: Sequence[str] | Mapping[str, Sequence[str]] = PERSONAL,
    mask: bool = True,
    exact: bool = True,
) -> DataFrame:
    """One row per column of the tables. Values of personal columns are masked unless asked not to.

    With `exact=False` the distinct counts are estimates and there are no samples; that saves
    the shuffle of distinct values.
    """
    return presented(measured(tables, exact), personal, mask)


def _hide(rows: DataFrame) -> DataFrame:
    personal = F.col("is_personal")
    return rows.withColumns(
        {
            "min_text": F.when(personal, masked(F.col("min_text"))).otherwise(F.col("min_text")),
            "max_text": F.when(personal, masked(F.col("max_text"))).otherwise(F.col("max_text")),
            "samples": F.when(personal, F.transform("samples", masked)).otherwise(F.col("samples")),
        }
    )


def profile(df: DataFrame, table: str, **options) -> DataFrame:
    return profiles({table: df}, **options)


# ------------------------------------------------------------------ catalog


def owner_of(table: str, owners: Mapping[str, str], default: str) -> str:
    return owners.get(table.partition("_")[2], default)


def catalog(
    profile_rows: DataFrame,
    tables: Sequence[str],
    lineage: Mapping[str, Sequence[str]],
    owners: Mapping[str, str],
    unowned: str,
) -> DataFrame:
    """One row per table: layer, owner, rows, upstream tables and the profiles of its columns.

    A table has as many columns as its schema, so the list per table is short.
    """
    name = F.col("table_name")
    facts = F.create_map(
        *[
            F.lit(part)
            for table in tables
            for part in (table, "\u0001".join([owner_of(table, owners, unowned), *lineage.get(table, [])]))
        ]
    )
    parts = F.split(F.element_at(facts, name), "\u0001")
    entry = F.struct(
        "ordinal", "column_name", "data_type", "null_count", "null_pct", "distinct_count", "distinct_pct",
        "min_text", "max_text", "mean", "stddev", "samples", "is_personal",
    )
    return (
        profile_rows.groupBy("table_name", "row_count")
        .agg(F.array_sort(F.collect_list(entry)).alias("columns"))
        .select(
            "table_name",
            F.substring_index(name, "_", 1).alias("layer"),
            F.element_at(parts, 1).alias("owner"),
            "row_count",
            F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("upstreams"),
            "columns",
        )
    )


# The layout of a catalog card.
CARD_COLUMNS = "| column | type | null % | distinct | PII | min | max | sample values |"
CARD_RULE = "|---|---|---|---|---|---|---|---|"
NO_UPSTREAM = "— (raw landing)"


def _card_line(column: Column) -> Column:
    missing = F.lit("None")
    cells = [
        column["column_name"],
        column["data_type"],
        F.format_string("%.1f%%", column["null_pct"]),
        column["distinct_count"].cast("string"),
        F.when(column["is_personal"], "yes").otherwise(""),
        F.coalesce(column["min_text"], missing),
        F.coalesce(column["max_text"], missing),
        F.concat_ws(", ", column["samples"]),
    ]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def cards(catalog_rows: DataFrame) -> DataFrame:
    """A Markdown card per table, the text that catalog search works on."""
    upstreams = F.when(F.size("upstreams") > 0, F.concat_ws(", ", "upstreams")).otherwise(NO_UPSTREAM)
    card = F.concat_ws(
        "\n",
        F.concat(F.lit("# Table: "), F.col("table_name")),
        F.concat(F.lit("- Medallion layer: **"), F.col("layer"), F.lit("**")),
        F.concat(F.lit("- Business domain / owner: "), F.col("owner")),
        F.concat(F.lit("- Row count: "), F.format_number("row_count", 0)),
        F.concat(F.lit("- Upstream tables (lineage): "), upstreams),
        F.lit(""),
        F.lit("## Columns"),
        F.lit(CARD_COLUMNS),
        F.lit(CARD_RULE),
        F.array_join(F.transform("columns", _card_line), "\n"),
    )
    return catalog_rows.select("table_name", card.alias("card"))


def column_listing(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Columns in table order with their types and how many values each holds."""

    def listing(table: str, df: DataFrame) -> DataFrame:
        fields = list(enumerate(df.schema.fields, start=1))
        filled = df.selectExpr(*[f"count({_quoted(f.name)}) AS _{i}" for i, f in fields])
        rows = [
            f"named_struct('table_name', '{table}', 'ordinal', {i}, 'column_name', {_literal(f.name)}, "
            f"'data_type', '{type_name(f.dataType)}', 'n_values', _{i})"
            for i, f in fields
        ]
        return filled.selectExpr(_inlined(rows))

    return reduce(DataFrame.unionByName, [listing(name, df) for name, df in tables.items()])


def lineage_edges(counts: DataFrame, lineage: Mapping[str, Sequence[str]]) -> DataFrame:
    """Direct upstream tables with the rows on both ends; a landed table has none.

    `counts` has one row per table, so both ends come from the same small result.
    """
    pairs = [(table, up) for table, ups in lineage.items() for up in ups]
    edges = F.array(
        *[F.struct(F.lit(t).alias("table_name"), F.lit(u).alias("upstream")) for t, u in pairs]
    )
    rows = counts.agg(F.map_from_entries(F.collect_list(F.struct("table_name", "n_rows"))).alias("_rows"))
    own = rows.select(F.col("_rows"), F.inline(edges))
    landed = rows.select(
        F.col("_rows"), F.explode(F.map_keys("_rows")).alias("table_name"), F.lit(None).cast("string").alias("upstream")
    ).filter(~F.col("table_name").isin(list(lineage)))
    return own.unionByName(landed).select(
        "table_name",
        "upstream",
        F.element_at("_rows", F.col("table_name")).alias("n_rows"),
        F.when(F.col("upstream").isNotNull(), F.element_at("_rows", F.col("upstream"))).alias("n_upstream_rows"),
    )


def hide_personal(df: DataFrame, personal: Iterable[str] = PERSONAL) -> DataFrame:
    """A table with its personal columns masked, as text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    hidden = {c: masked(F.expr(as_text(_quoted(c), types[c]))) for c in personal if c in types}
    return df.withColumns(hidden) if hidden else df
