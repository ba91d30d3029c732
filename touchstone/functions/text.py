"""Text rules as column expressions, so they stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    DoubleType,
    FloatType,
    StructType,
    TimestampNTZType,
    TimestampType,
)


def capitalised(value: Column) -> Column:
    """Upper-case the first letter of the whole trimmed text and lower-case the rest.

    Spark's own initcap works per word, which gives other results for "new york".
    """
    text = F.trim(value)
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def code(value: Column) -> Column:
    """Trimmed upper-case code; a blank one is missing."""
    return F.upper(F.nullif(F.trim(value), F.lit("")))


def plausible_email(value: Column) -> Column:
    return F.when(value.like("%@%.%"), F.lower(value))


def masked(value: Column) -> Column:
    """Hide a personal value but keep its shape.

    An address keeps its first character and everything after the first "@"; any other text
    keeps its first character and its length.
    """
    at = F.instr(value, "@")
    local = F.left(value, F.least(F.lit(1), at - 1))
    address = F.concat(local, F.lit("***@"), F.substr(value, at + 1))
    stars = F.rpad(F.left(value, F.lit(1)), F.length(value), F.lit("*"))
    return F.when(at > 0, address).when(F.length(value) <= 1, F.lit("*")).otherwise(stars)


def verdict(review: Column) -> Column:
    """APPROVE or REVISE as the review states it; a review without a verdict asks for changes."""
    # The verdict line and the default.
    found = F.upper(F.regexp_extract(review, r"(?i)VERDICT:\s*(APPROVE|REVISE)", 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("REVISE"))


def table_references(log: DataFrame, text: str, tables: list[str]) -> DataFrame:
    """One row per logged text and table it names, as a whole word and in any case."""
    named = F.array_compact(
        F.array(*[F.when(F.col(text).rlike(rf"(?i)\b{name}\b"), F.lit(name)) for name in tables])
    )
    return log.withColumn("table_name", F.explode(named))


def json_document(schema: StructType) -> Column:
    """A row as JSON text: moments in ISO form with any part of a second, NaN and missing values as null."""
    fields = []
    for field in schema.fields:
        value = F.col(field.name)
        if isinstance(field.dataType, DoubleType | FloatType):
            value = F.when(~F.isnan(value), value)
        elif isinstance(field.dataType, DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        elif isinstance(field.dataType, TimestampType | TimestampNTZType):
            part = F.date_format(value, ".SSSSSS")
            seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
            value = F.concat(seconds, F.when(part == ".000000", F.lit("")).otherwise(part))
        fields.append(value.alias(field.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
