"""Column functions: division without errors, rounding for output, sessions, timeframes.

Missing is NULL everywhere, never NaN; comparisons with missing count as false."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMEFRAMES = {"1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "30min": "30 minutes", "1h": "1 hour", "1day": "1 day"}
SECONDS = {"1min": 60, "5min": 300, "15min": 900, "30min": 1800, "1h": 3600, "1day": 86400}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NULL for NaN and infinities."""
    x = col(x)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def divide(a: Column | str, b: Column | str) -> Column:
    """NULL for a zero divisor or a result that isn't finite."""
    return F.try_divide(col(a).cast("double"), F.nullif(col(b).cast("double"), F.lit(0.0)))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's, an aggregate over rows that have both; NULL where either doesn't vary (corr() raises there)."""
    x, y = F.when(col(b).isNotNull(), col(a).cast("double")), F.when(col(a).isNotNull(), col(b).cast("double"))
    return clean(F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def minute_of_day(ts: Column | str = "ts") -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_minutes(start: int, end: int, ts: Column | str = "ts") -> Column:
    """Half-open session by minute of the day."""
    return (minute_of_day(ts) >= start) & (minute_of_day(ts) < end)


def in_hours(start: int, end: int, ts: Column | str = "ts") -> Column:
    return (F.hour(ts) >= start) & (F.hour(ts) < end)


def is_main_session(ts: Column | str = "ts") -> Column:
    """Weekday between 07:00 and 15:40 UTC, half-open."""
    return F.weekday(ts).isin(0, 1, 2, 3, 4) & in_minutes(420, 940, ts)


def in_local_session(ts: Column | str = "ts", zone: str = "Europe/Moscow", start: int = 600, end: int = 1125) -> Column:
    """By local time, both ends included."""
    local = F.from_utc_timestamp(ts, zone)
    return minute_of_day(local).between(start, end)


def quotation(units: Column | str, nano: Column | str) -> Column:
    return col(units) + col(nano) / F.lit(1e9)


def order_id(*parts: Column | str) -> Column:
    """Same parts, same id: 16 hex digits."""
    return F.substring(F.sha1(F.concat_ws("|", *[col(p).cast("string") for p in parts])), 1, 16)


OPS = {
    "mul": lambda a, b: clean(a * b),
    "div": divide,
    "add": lambda a, b: clean(a + b),
    "sub": lambda a, b: clean(a - b),
    "rel": lambda a, b: divide(a - b, a + b),
}
