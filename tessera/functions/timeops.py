"""Time expressions that keep TIMESTAMP_NTZ columns as they are. Intervals are half-open and named by their start."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000


def moment(at: datetime | Column) -> Column:
    """A literal TIMESTAMP_NTZ, whatever the session's time zone."""
    return at if isinstance(at, Column) else F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_minutes(ts: Column, minutes: int) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(minutes * MINUTE)))


def ceil_minutes(ts: Column, minutes: int) -> Column:
    return floor_minutes(from_micros(micros(ts) + (minutes * MINUTE - 1)), minutes)


def plus_minutes(ts: Column, minutes: int | Column) -> Column:
    return from_micros(micros(ts) + (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("long") * F.lit(MINUTE))


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes, cut toward zero."""
    return ((micros(end) - micros(start)) / F.lit(MINUTE)).cast("long")


def on_boundary(ts: Column, minutes: int) -> Column:
    return F.pmod(micros(ts), F.lit(minutes * MINUTE)) == 0


def grid(first: Column, last: Column, minutes: int) -> Column:
    """Every start from first to last, both included."""
    return F.transform(F.sequence(micros(first), micros(last), F.lit(minutes * MINUTE)), from_micros)


def local_time(utc: Column, zone: Column | str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone) if isinstance(zone, str) else zone, utc)


def utc_time(local: Column, zone: Column | str) -> Column:
    return F.convert_timezone(F.lit(zone) if isinstance(zone, str) else zone, F.lit("UTC"), local)
