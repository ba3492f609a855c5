"""Day arithmetic. Days are dates inside the engine and yyyyMMdd integers at its edges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: one window part is 60*60*60 seconds, that is two and a half days.
DAYS_PER_PART = 2.5


def int_to_day(col: Column | str) -> Column:
    """yyyyMMdd integer to date; values that are no date (such as 0) give NULL."""
    c = F.col(col) if isinstance(col, str) else col
    return F.try_to_timestamp(c.cast("string"), F.lit("yyyyMMdd")).cast("date")


def day_to_int(col: Column | str) -> Column:
    """Date to yyyyMMdd integer."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def as_day(df: DataFrame, name: str) -> Column:
    """Column ``name`` of ``df`` as a date, whatever of the accepted types it has."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.col(name)
    if isinstance(kind, T.IntegralType):
        return int_to_day(name)
    if isinstance(kind, T.StringType):
        return int_to_day(name)
    return F.col(name).cast("date")


def part_days(parts: int, days_per_part: float = DAYS_PER_PART) -> int:
    """Signed whole days moved by ``parts`` window parts (half days truncate towards the past)."""
    return math.floor(days_per_part * parts)


def shift_day(col: Column, parts: int, days_per_part: float = DAYS_PER_PART) -> Column:
    return F.date_add(col, part_days(parts, days_per_part))


def shift_parts(col: Column | str, parts: int, days_per_part: float = DAYS_PER_PART) -> Column:
    """Shift a yyyyMMdd integer by ``parts`` window parts."""
    return day_to_int(shift_day(int_to_day(col), parts, days_per_part))


def left_days(until: Column | str, since: Column | str) -> Column:
    """Whole days from ``since`` to ``until``, both yyyyMMdd integers."""
    return F.datediff(int_to_day(until), int_to_day(since))
