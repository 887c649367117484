"""Date/time column functions (N8, N9, N12, N14, N15) and report time filters
(P5 rolling month, P6 inclusive range, P7 calendar months).

Filters compare the column with a literal *of the column's own type*, so the
predicate is never wrapped in a cast and Catalyst pushes it into the parquet
scan (``PushedFilters``) for both ``date`` and ``timestamp``/``timestamp_ntz``
columns.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the dashboard's default range is "now - 1 month" .. "now".
DEFAULT_RANGE_MONTHS = 1


def add_months(ts: dt.datetime, months: int) -> dt.datetime:
    """Calendar month shift that clamps to the month's last day (as SQL does)."""
    y, m = divmod(ts.month - 1 + months, 12)
    year, month = ts.year + y, m + 1
    day = min(ts.day, calendar.monthrange(year, month)[1])
    return ts.replace(year=year, month=month, day=day)


def _as_datetime(v) -> dt.datetime:
    if isinstance(v, dt.datetime):
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    return dt.datetime.fromisoformat(str(v))


def typed_literal(dtype: T.DataType, value, lower_bound: bool = True) -> Column:
    """Literal for ``value`` in the type of the compared column.

    For a ``date`` column compared with a timestamp bound the date is
    promoted to 00:00, so ``date >= ts`` keeps the first date whose midnight
    is not before ``ts`` (and ``date <= ts`` the last date not after it).
    """
    ts = _as_datetime(value)
    if isinstance(dtype, T.DateType):
        d = ts.date()
        if lower_bound and ts.time() != dt.time(0):
            d = d + dt.timedelta(days=1)
        return F.lit(d.isoformat()).cast("date")
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp")


def rolling_month_filter(df: DataFrame, col: str, as_of, months: int = 1) -> DataFrame:
    """P5: ``col >= as_of - N months`` (no upper bound)."""
    cutoff = add_months(_as_datetime(as_of), -months)
    return df.filter(F.col(col) >= typed_literal(df.schema[col].dataType, cutoff))


def time_range_filter(df: DataFrame, col: str, frm, to) -> DataFrame:
    """``frm <= col <= to``, both ends inclusive."""
    dtype = df.schema[col].dataType
    return df.filter(
        (F.col(col) >= typed_literal(dtype, frm, lower_bound=True))
        & (F.col(col) <= typed_literal(dtype, to, lower_bound=False))
    )


def default_range(as_of) -> tuple[dt.datetime, dt.datetime]:
    """The dashboard default: now-1M .. now."""
    to = _as_datetime(as_of)
    return add_months(to, -DEFAULT_RANGE_MONTHS), to


def calendar_month_filter(df: DataFrame, col: str, as_of, months: int = 1) -> DataFrame:
    """Since the start of the month ``months`` before the as-of month."""
    start = calendar_month_start(as_of, months)
    return df.filter(F.col(col) >= typed_literal(df.schema[col].dataType, start))


def calendar_month_start(as_of, months: int = 1) -> dt.datetime:
    """The first day of the month ``months`` before the as-of month."""
    ts = _as_datetime(as_of)
    return add_months(dt.datetime(ts.year, ts.month, 1), -months)


def day_trunc(c) -> Column:
    """Start of day as a DATE."""
    return F.to_date(c)


def month_trunc(c) -> Column:
    """Start of month as a DATE."""
    return F.trunc(F.to_date(c), "month")


def format_datetime(c) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` or null."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def iso_format(c) -> Column:
    """ISO-8601 text like Python's ``isoformat()``: microseconds only when non-zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.date_format(c, "SSSSSS") == "000000", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def second_precision(c) -> Column:
    """Truncate to whole seconds."""
    return F.date_trunc("second", c)


# Fixed value: optional time part, fraction and zone of ISO-8601 text.
ISO_FULL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"


def _iso_ts(s: Column) -> Column:
    # Callers guard the text with ISO_FULL first, so the cast never sees
    # numbers such as '123456' that a bare cast would read as a year.
    return s.try_cast("timestamp")


def iso_is_valid(c) -> Column:
    s = F.trim(c)
    return s.rlike(ISO_FULL) & _iso_ts(s).isNotNull()


def iso_to_date(c) -> Column:
    """The calendar date written in ISO text (no time-zone shift).

    null/'' -> null; text that is not ISO-8601 -> null (the caller marks the
    row as rejected with :func:`iso_reject`).
    """
    s = F.trim(c)
    return F.when(iso_is_valid(c), F.substring(s, 1, 10).try_cast("date"))


def iso_reject(c) -> Column:
    """True when a non-empty value is not a valid ISO-8601 date/time."""
    return c.isNotNull() & (c != "") & ~iso_is_valid(c)


def iso_to_timestamp(c) -> Column:
    """ISO text -> timestamp (UTC); invalid or empty -> null."""
    return F.when(iso_is_valid(c), _iso_ts(F.trim(c)))
