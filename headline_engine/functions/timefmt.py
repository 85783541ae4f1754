"""UTC+8 calendar helpers (P23, P24), right in any session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headline_engine.config import LOCAL_TZ


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def local_ts(col, tz: str = LOCAL_TZ) -> Column:
    """Wall-clock time in ``tz`` of an instant. (A TIMESTAMP_NTZ column is session-local time; see from_utc_wall.)"""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), _c(col).cast("timestamp").cast("timestamp_ntz"))


def from_utc_wall(col) -> Column:
    """The instant of a TIMESTAMP_NTZ column that holds UTC wall-clock time."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), _c(col).cast("timestamp_ntz")).cast("timestamp")


def day_key(col, tz: str = LOCAL_TZ) -> Column:
    """P23: 'yyyyMMdd' of the UTC+8 day."""
    return F.date_format(local_ts(col, tz), "yyyyMMdd")


def local_day(col, tz: str = LOCAL_TZ) -> Column:
    return F.to_date(local_ts(col, tz))


def fmt_date(col, tz: str = LOCAL_TZ) -> Column:
    """Display date 'yyyy年MM月dd日' in UTC+8."""
    return F.date_format(local_ts(col, tz), "yyyy'年'MM'月'dd'日'")


def fmt_time(col, tz: str = LOCAL_TZ) -> Column:
    """Display time 'HH时mm分' in UTC+8."""
    return F.date_format(local_ts(col, tz), "HH'时'mm'分'")


def ts_text(col) -> Column:
    """UTC text form of an instant for reports and oracle comparison."""
    return F.date_format(local_ts(col, "UTC"), "yyyy-MM-dd HH:mm:ss")
