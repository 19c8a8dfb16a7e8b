"""Time columns.  The model keeps UTC wall-clock values (TIMESTAMP_NTZ)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayside.functions.text import non_blank

# fixed values: accepted text forms
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
NAIVE_STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$"
EPOCH = "1970-01-01 00:00:00"


def utc_naive(stamp: Column) -> Column:
    """An instant as the UTC wall clock, whatever the session zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), stamp.cast("timestamp_ntz"))


def rfc3339_utc(col) -> Column:
    """RFC 3339 text to UTC; null when the text has another form."""
    text = F.upper(F.col(col) if isinstance(col, str) else col)
    return F.when(text.rlike(RFC3339), utc_naive(F.try_to_timestamp(text)))


def date_utc(col) -> Column:
    """`YYYY-MM-DD` to UTC midnight; null when the text is no such date."""
    text = F.col(col) if isinstance(col, str) else col
    return F.when(text.rlike(ISO_DATE), F.try_to_date(text).cast("timestamp_ntz"))


def event_time(col) -> Column:
    """A time stamp or a date; null for blank or unreadable text."""
    text = non_blank(col)
    return F.coalesce(rfc3339_utc(text), date_utc(text))


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours between two UTC wall clocks, free of the session zone."""
    seconds = (later - earlier).cast("interval second").cast("decimal(24,6)").cast("double")
    return seconds / F.lit(3600.0)
