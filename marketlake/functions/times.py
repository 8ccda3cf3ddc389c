"""New York wall time without any dependence on the session time zone.

Everything stays in TIMESTAMP_NTZ: an LTZ value would be rendered in, or converted through,
the session zone, and daylight-saving hours of that zone would leak into the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEW_YORK = "America/New_York"
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_micros(utc: Column) -> Column:
    """UTC wall time (NTZ) -> microseconds since the epoch.

    Subtraction of two NTZ values is free of zones; ``timestamp_diff`` would cast both through
    the session zone and be an hour off around that zone's clock changes.
    """
    seconds = (utc - F.expr(EPOCH)).cast("interval second").cast("decimal(18,6)")
    return (seconds * 1_000_000).cast("bigint")


def wall_time(micros: Column) -> Column:
    """Microseconds since the epoch -> UTC wall time (NTZ)."""
    return F.timestamp_add("MICROSECOND", micros, F.expr(EPOCH))


def ny_from_micros(micros: Column) -> Column:
    """Microseconds since the epoch -> New York wall time (NTZ).

    ``from_utc_timestamp`` shifts the instant by the zone's offset, whatever the session zone;
    reading the result back as microseconds keeps it that way. It looks the zone up once per
    task, while ``convert_timezone`` does so for every row and takes several times as long.
    """
    shifted = F.from_utc_timestamp(F.timestamp_micros(micros), NEW_YORK)
    return wall_time(F.unix_micros(shifted))


def ny_from_utc(utc: Column) -> Column:
    """UTC wall time -> New York wall time."""
    return ny_from_micros(epoch_micros(utc))


def ny_from_epoch_ns(ns: Column) -> Column:
    """Nanoseconds since the epoch -> New York wall time."""
    return ny_from_micros(F.call_function("div", ns, F.lit(1000)))


def ny_epoch_seconds(day: Column, minute: Column) -> Column:
    """Unix seconds of a New York wall-clock minute on ``day``."""
    wall = F.timestamp_add("MINUTE", minute, day.cast("timestamp_ntz"))
    utc = F.convert_timezone(F.lit(NEW_YORK), F.lit("UTC"), wall)
    return F.call_function("div", epoch_micros(utc), F.lit(1_000_000))


def minute_of_day(wall: Column) -> Column:
    return F.hour(wall) * 60 + F.minute(wall)
