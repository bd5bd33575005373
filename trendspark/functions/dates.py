"""Date expressions used by scans and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def compact_day(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")


def iso_instant(moment: Column) -> Column:
    """ISO text with Z; the moment is rendered in the session zone, which is UTC here."""
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def window_end(day: Column) -> Column:
    """Closing bound of a day window: the next day, included."""
    return F.date_add(day, 1)
