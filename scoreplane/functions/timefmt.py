"""Time expressions (E14, E15); the session time zone is expected to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nanos_to_seconds(c) -> Column:
    return _col(c).cast("double") / F.lit(1e9)


def elapsed_seconds(start, end) -> Column:
    """Seconds between two instants, microsecond exact; works on TIMESTAMP and
    TIMESTAMP_NTZ without going through the session time zone."""
    return F.timestamp_diff("MICROSECOND", _col(start), _col(end)).cast("double") / F.lit(1e6)


def iso_utc(c) -> Column:
    """ISO-8601 with microseconds and a +00:00 offset."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def run_stamp(c) -> Column:
    """Compact run stamp, e.g. 20250619_130001."""
    return F.date_format(_col(c), "yyyyMMdd_HHmmss")
