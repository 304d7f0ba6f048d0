"""Times: zone-aware parsing, and the forms in which they are written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_time(value: Column) -> Column:
    """A timestamp from text or a date: with an offset as it says, without one in the session's zone, a date at midnight; else null."""
    return value.try_cast("timestamp")


def zulu(time: Column) -> Column:
    """ISO 8601 in UTC with a Z, with microseconds only if there are any."""
    utc = F.to_utc_timestamp(time, F.current_timezone())
    whole = F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.pmod(F.unix_micros(time), F.lit(1_000_000))
    return F.concat(whole, F.when(micros > 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(""), F.lit("Z"))


def iso_offset(time: Column) -> Column:
    """ISO 8601 with the offset of the session's zone."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssxxx")


def end_or_day(start: Column, end: Column) -> Column:
    """end, or 24 hours after start if there is none."""
    return F.coalesce(end, start + F.expr("interval 24 hours"))
