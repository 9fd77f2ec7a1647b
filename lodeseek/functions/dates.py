"""Timestamps of date-time texts, and the date functions of filters, as columns. Sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NORMAL = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
_FORM = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|z|[+-]\d{2}:\d{2})?| \d{2}:\d{2}:\d{2})?$"
PARTS = {
    "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute,
    "second": F.second, "dayofweek": lambda c: F.dayofweek(c) - 1, "dayofyear": F.dayofyear,
}
SECONDS = {"week": 604800, "day": 86400, "hour": 3600, "minute": 60, "second": 1}
MONTHS = {"year": 12, "quarter": 3, "month": 1}


def timestamp(col: Column) -> Column:
    """Timestamp of a text in one of the accepted forms, else null."""
    return F.when(col.rlike(_FORM), F.try_to_timestamp(F.upper(col)))


def normal(ts: Column) -> Column:
    """Fixed-width text in UTC to the millisecond, so that texts sort as times do."""
    return F.date_format(ts, NORMAL)


def part(name: str, ts: Column) -> Column:
    return PARTS[name](ts)


def date_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T00:00:00.000Z'")


def time_of(ts: Column) -> Column:
    return F.date_format(ts, "'0001-01-01T'HH:mm:ss.SSS'Z'")


def add(unit: str, n: int, ts: Column) -> Column:
    """Months and longer clamp to the month's end; results outside the years 1 to 9999 are null."""
    if unit in MONTHS:
        out = F.timestamp_add("MONTH", F.lit(n * MONTHS[unit]), ts)
    else:
        out = F.timestamp_add("SECOND", F.lit(n * SECONDS[unit]).cast("long"), ts)
    return F.when(F.year(out).between(1, 9999), normal(out))


def diff(unit: str, a: Column, b: Column) -> Column:
    """From a to b: calendar months, years and quarters of them rounded down; shorter units towards zero."""
    if unit in MONTHS:
        months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
        return F.floor(months / MONTHS[unit])
    micros = F.unix_micros(b) - F.unix_micros(a)
    whole = micros / (SECONDS[unit] * 1_000_000)
    return F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole))
