"""Date rules as column expressions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The onboarding age and the earliest believable date of birth.
ADULT_YEARS = 18
EARLIEST_BIRTH = "1910-01-01"


def latest_adult_birth(onboarded: Column) -> Column:
    """Last birth date that makes an adult on the onboarding day; 29 February falls back to 28."""
    return F.add_months(onboarded, -12 * ADULT_YEARS)


def earliest_birth() -> Column:
    return F.lit(EARLIEST_BIRTH).cast("date")


def naive_timestamp(moment: datetime) -> Column:
    """A timestamp literal without a time zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def month_of(moment: Column) -> Column:
    """The first of the month as a timestamp. By way of a date, since truncating a timestamp
    would take it through the session time zone."""
    return F.trunc(moment.cast("date"), "month").cast("timestamp_ntz")


def month_label(moment: Column) -> Column:
    """The month as text, `2001-03`."""
    return F.date_format(moment.cast("date"), "yyyy-MM")
