"""Date and time helpers."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, functions as F

LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_timestamp(c, fmt: str = LOG_TS_FORMAT, strict: bool = False) -> Column:
    """Parse text to a timestamp; malformed text gives null unless ``strict``."""
    return F.to_timestamp(_c(c), F.lit(fmt)) if strict else F.try_to_timestamp(_c(c), F.lit(fmt))


def month_start(c) -> Column:
    """First day of the month of a date or timestamp, as a date."""
    return F.trunc(_c(c).cast("date"), "MM")


def month_name(c) -> Column:
    """Full English month name (``January``)."""
    return F.date_format(_c(c), "MMMM")


def month_range(year: int, month: int) -> tuple[_dt.date, _dt.date]:
    start = _dt.date(year, month, 1)
    end = _dt.date(year + (month == 12), month % 12 + 1, 1)
    return start, end


def in_month(c, year: int, month: int) -> Column:
    """``year(c) = y AND month(c) = m`` as a half-open range, so both bounds
    reach the Parquet scan as pushed filters."""
    start, end = month_range(year, month)
    return (_c(c) >= F.lit(start)) & (_c(c) < F.lit(end))
