"""Instants and dates from the spellings found in the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A date, or a date and time with "T" or a blank, with or without fraction and offset.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?( ?(Z|UTC|[+-]\d{2}(:?\d{2})?))?)?$"
DAY = 86400
DATE = r"^\d{4}-\d{2}-\d{2}$"


def utc_seconds(text: Column, end_of_day: bool = False) -> Column:
    """Epoch second of an ISO-8601 text as bigint; null where it cannot be read.

    Without an offset the text is UTC, whatever the session's time zone. A bare date means its first
    second, or its last with ``end_of_day``. Fractions are cut off.
    """
    t = F.upper(F.trim(text))
    bare = t.rlike(DATE)
    # the date part must not be searched for an offset, so look behind the time only
    zoned = t.rlike(r"[T ]\d{2}:.*(Z|UTC|[+-]\d{2}(:?\d{2})?)$")
    whole = F.when(bare, F.concat(t, F.lit("T00:00:00Z"))).when(zoned, F.regexp_replace(t, " ?UTC$", "Z")).otherwise(F.concat(t, F.lit("Z")))
    whole = F.translate(whole, ",", ".")
    seconds = F.when(t.rlike(ISO), F.unix_seconds(whole.try_cast("timestamp")))
    return seconds + F.when(bare, F.lit(86399)).otherwise(F.lit(0)) if end_of_day else seconds


def utc_day(text: Column) -> Column:
    """Days since 1970-01-01 (UTC) of an ISO-8601 text as int; null where it cannot be read."""
    return F.floor(utc_seconds(text) / F.lit(86400)).cast("int")


def day_text(day: Column) -> Column:
    """YYYY-MM-DD of days since 1970-01-01."""
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def seconds_text(second: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SSZ of an epoch second, in UTC for every session time zone."""
    day = F.floor(second / F.lit(86400)).cast("int")
    rest = (second - day.cast("bigint") * 86400).cast("int")
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(day_text(day), F.lit("T"), part(rest / 3600), F.lit(":"), part((rest % 3600) / 60), F.lit(":"), part(rest % 60), F.lit("Z"))
