"""Tolerant parsing of raw text fields; anything unreadable becomes NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The day-first timestamp format of raw files; text without an offset is UTC.
DAY_FIRST_FORMAT = "dd/MM/yyyy HH:mm:ssXXX"
ISO_OFFSET_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"
UTC_SUFFIX = "+00:00"


def to_text(c: Column | str) -> Column:
    """Trimmed text, empty text as NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def to_double(c: Column | str) -> Column:
    return to_text(c).try_cast("double")


def to_long(c: Column | str) -> Column:
    """Whole number, by truncating a decimal text."""
    value = to_double(c)
    return F.when(F.abs(value) < 9.2e18, value).cast("bigint")


def parse_ts(c: Column | str) -> Column:
    """Day-first format, then ISO with offset, then Spark's default parsing."""
    text = to_text(c)
    as_utc = F.concat(text, F.lit(UTC_SUFFIX))
    return F.coalesce(
        F.try_to_timestamp(as_utc, F.lit(DAY_FIRST_FORMAT)),
        F.try_to_timestamp(text, F.lit(ISO_OFFSET_FORMAT)),
        F.try_to_timestamp(as_utc),
        F.try_to_timestamp(text),
    )


def epoch_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 as double for a timestamp with zone."""
    return F.unix_micros(ts) / F.lit(1e6)


def epoch_seconds_ntz(ts: Column | str) -> Column:
    """Seconds since 1970 as double for a timestamp without zone, read as UTC."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts) / F.lit(1e6)


def epoch_day(t: str = "t") -> Column:
    """UTC date of epoch seconds, whatever the session time zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(t) / 86400.0).cast("int"))
