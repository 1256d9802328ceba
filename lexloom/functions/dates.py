"""Dates as the sources write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a date that is missing.
NO_DATE = "0001-01-01"


def iso_date(x: Column) -> Column:
    """YYYY-MM-DD or YYYYMMDD as a date; null for anything else."""
    return F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "yyyyMMdd"))


def promulgation_date(x: Column) -> Column:
    """The date, or the sentinel where it is missing or unreadable."""
    return F.coalesce(iso_date(x), F.lit(NO_DATE).cast("date"))


def reference_date(x: Column) -> Column:
    """The date, or today where it is missing or unreadable."""
    return F.coalesce(iso_date(x), F.current_date())


def validity(dates: Column) -> tuple[Column, Column]:
    """Aggregates: earliest date, and the latest if it is another one, of the dates of an act's events."""
    return F.min(dates), F.nullif(F.max(dates), F.min(dates))
