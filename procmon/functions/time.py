"""Timestamp arithmetic on ``timestamp_ntz`` columns, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed unit sizes in microseconds
UNIT_US = {"us": 1, "ms": 1_000, "s": 1_000_000, "m": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}


def micros_between(start: Column, end: Column) -> Column:
    """Exact ``end - start`` in microseconds (bigint)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz (bigint, no time-zone shift)."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def in_unit(micros: Column, unit: str) -> Column:
    """Microseconds to a double in ``unit`` (one division, the same in SQL)."""
    return micros / F.lit(float(UNIT_US[unit]))
