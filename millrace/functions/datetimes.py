"""Date and time functions on timestamps without zone."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..semantics import col

#: Microseconds from 0001-01-01 (a Monday) to 1970-01-01.
ORIGIN = 719_162 * 86_400_000_000
UNITS = {"ms": 1_000, "s": 1_000_000, "m": 60_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000, "w": 7 * 86_400_000_000}


def width_micros(width: str) -> int:
    """Microseconds of a width such as '5m', '2h', '1w'."""
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", width.lower())
    if not m or m[2] not in UNITS or not int(m[1]):
        raise ValueError(f"bad width {width!r}")
    return int(m[1]) * UNITS[m[2]]


def micros(a) -> Column:
    return F.unix_micros(col(a).cast("timestamp"))


def from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def year(a):
    return F.year(col(a))


def month(a):
    return F.month(col(a))


def day(a):
    return F.dayofmonth(col(a))


def hour(a):
    return F.hour(col(a))


def minute(a):
    return F.minute(col(a))


def second(a):
    return F.second(col(a))


def day_of_week(a):
    """Sunday is 0."""
    return F.dayofweek(col(a)) - 1


def day_of_year(a):
    return F.dayofyear(col(a))


def quarter(a):
    return F.quarter(col(a))


def millisecond(a):
    return F.pmod(F.floor(micros(a) / 1000), F.lit(1000)).cast("int")


def microsecond(a):
    return F.pmod(micros(a), F.lit(1000)).cast("int")


def is_month_start(a):
    return F.dayofmonth(col(a)) == 1


def is_month_end(a):
    return F.to_date(col(a)) == F.last_day(col(a))


def is_quarter_start(a):
    return (F.dayofmonth(col(a)) == 1) & (F.month(col(a)) % 3 == 1)


def is_quarter_end(a):
    return is_month_end(a) & (F.month(col(a)) % 3 == 0)


def is_year_start(a):
    return F.dayofyear(col(a)) == 1


def is_year_end(a):
    return (F.month(col(a)) == 12) & (F.dayofmonth(col(a)) == 31)


def is_leap_year(a):
    y = F.year(col(a))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def date(a):
    return F.date_trunc("day", col(a)).cast("timestamp_ntz")


def floor(a, width: str):
    w = width_micros(width)
    m = micros(a) + ORIGIN
    return from_micros(m - F.pmod(m, F.lit(w)) - ORIGIN)


def ceil(a, width: str):
    w = width_micros(width)
    m = micros(a) + ORIGIN
    return from_micros(m + F.pmod(-m, F.lit(w)) - ORIGIN)


def round_half_up(a, width: str):
    w = width_micros(width)
    m = micros(a) + ORIGIN + w // 2
    return from_micros(m - F.pmod(m, F.lit(w)) - ORIGIN)


def add_days(a, n: int):
    return from_micros(micros(a) + n * UNITS["d"])


def add_hours(a, n: int):
    return from_micros(micros(a) + n * UNITS["h"])


def add_months(a, n: int):
    """Same time of day; the day is cut to the month's end."""
    m = micros(a)
    days = F.to_date(col(a))
    return from_micros(m + (F.datediff(F.add_months(days, n), days)).cast("long") * UNITS["d"])


def add_years(a, n: int):
    return add_months(a, 12 * n)


def date_range(spark: SparkSession, start: str, end: str | None = None, step: str = "1d", periods: int | None = None, name: str = "date") -> DataFrame:
    """Timestamps from start by step, to ``end`` inclusive or for ``periods``; generated in parallel."""
    w = width_micros(step)
    first = spark.sql(f"SELECT unix_micros(timestamp '{start}')").first()[0]
    if periods is None:
        last = spark.sql(f"SELECT unix_micros(timestamp '{end}')").first()[0]
        periods = max(0, (last - first) // w + 1)
    return spark.range(periods).select(from_micros(F.lit(first) + F.col("id") * w).alias(name))
