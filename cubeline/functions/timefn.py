"""Calendar buckets in a time zone, on epoch milliseconds, as column expressions.

All buckets go through one function, so an axis and the buckets of the data agree
by construction, whatever daylight saving does. Weeks begin on Sunday.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
UNITS = ("HOURS", "DAYS", "WEEKS", "MONTHS", "QUARTERS")
_STEP = {"DAYS": "1 day", "WEEKS": "7 days", "MONTHS": "1 month", "QUARTERS": "3 months"}


def floor_hour(ms: Column) -> Column:
    return ms - F.pmod(ms, F.lit(HOUR_MS))


def floor_day(ms: Column) -> Column:
    """Day in UTC."""
    return ms - F.pmod(ms, F.lit(24 * HOUR_MS))


def to_local(ms: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), zone)


def to_ms(local: Column, zone: str) -> Column:
    return F.unix_millis(F.to_utc_timestamp(local, zone))


def local_start(local: Column, unit: str) -> Column:
    """First local moment of the unit that a local timestamp is in."""
    if unit == "DAYS":
        return F.date_trunc("day", local)
    if unit == "WEEKS":
        return F.date_trunc("week", local + F.expr("interval 1 day")) - F.expr("interval 1 day")
    if unit == "MONTHS":
        return F.date_trunc("month", local)
    if unit == "QUARTERS":
        return F.date_trunc("quarter", local)
    raise ValueError(f"unit must be one of {UNITS}: {unit}")


def bucket(ms: Column, unit: str, zone: str = "UTC") -> Column:
    """Start of the unit that ``ms`` is in, as epoch milliseconds. Hours are those of UTC."""
    if unit == "HOURS":
        return floor_hour(ms)
    return to_ms(local_start(to_local(ms, zone), unit), zone)


def round_to_day(ms: Column, zone: str) -> Column:
    return bucket(ms, "DAYS", zone)


def round_to_week(ms: Column, zone: str) -> Column:
    return bucket(ms, "WEEKS", zone)


def round_to_month(ms: Column, zone: str) -> Column:
    return bucket(ms, "MONTHS", zone)


def round_to_quarter(ms: Column, zone: str) -> Column:
    return bucket(ms, "QUARTERS", zone)


def axis(bounds: DataFrame, unit: str, zone: str = "UTC") -> DataFrame:
    """(time_ms), ascending, of a one-row frame (start_ms, end_ms, lo_ms, hi_ms).

    lo_ms and hi_ms are the range of the data. Hours cover the request, both ends
    included, data or not. Other units cover what request and data share, without
    its first and last unit, which may be partial; quarters keep the first.
    Nulls (no data) give an empty axis.
    """
    if unit == "HOURS":
        first, last, step = floor_hour(F.col("start_ms")), floor_hour(F.col("end_ms")), F.lit(HOUR_MS).cast("long")
        listed = F.when(first <= last, F.sequence(first, last, step))
        return bounds.select(F.explode(listed).alias("time_ms"))
    start, end = F.greatest("start_ms", "lo_ms"), F.least("end_ms", "hi_ms")
    there = F.col("lo_ms").isNotNull() & F.col("hi_ms").isNotNull()
    step = F.expr(f"interval {_STEP[unit]}") if unit in _STEP else local_start(start, unit)
    first, last = (local_start(to_local(x, zone), unit).cast("timestamp_ntz") for x in (start, end))
    first = first if unit == "QUARTERS" else first + step
    last = last - step
    listed = F.when(there & (first <= last), F.sequence(first, last, step))
    days = bounds.select(F.explode(listed).alias("local"))
    return days.select(to_ms(F.col("local").cast("timestamp"), zone).alias("time_ms"))


def request(spark: SparkSession, start_ms: int, end_ms: int) -> DataFrame:
    return spark.range(1).select(F.lit(start_ms).cast("long").alias("start_ms"), F.lit(end_ms).cast("long").alias("end_ms"))


def relative_range(now_ms: int, count: int, unit: str) -> tuple[int, int]:
    """(start, end) of the last ``count`` DAYS, WEEKS or MONTHS before ``now_ms``, in UTC; a month's end is clipped."""
    import calendar
    import datetime as dt

    now = dt.datetime.fromtimestamp(now_ms / 1000, dt.timezone.utc)
    if unit in ("DAYS", "WEEKS"):
        start = now - dt.timedelta(days=count * (7 if unit == "WEEKS" else 1))
    elif unit == "MONTHS":
        months = now.year * 12 + now.month - 1 - count
        year, month = divmod(months, 12)
        start = now.replace(year=year, month=month + 1, day=min(now.day, calendar.monthrange(year, month + 1)[1]))
    else:
        raise ValueError(f"not a unit of a relative range: {unit}")
    return round(start.timestamp() * 1000), now_ms


def ordinal(day: Column) -> Column:
    suffix = F.when(day.between(11, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), suffix)


def label(ms: Column, unit: str, zone: str = "UTC") -> Column:
    """Text of a bucket for people: ``Q1 2013``, ``Jan 2013``, ``Jan 5th``."""
    local = to_local(ms, zone)
    if unit == "QUARTERS":
        return F.concat(F.lit("Q"), F.quarter(local).cast("string"), F.lit(" "), F.year(local).cast("string"))
    if unit == "MONTHS":
        return F.date_format(local, "MMM yyyy")
    return F.concat(F.date_format(local, "MMM "), ordinal(F.dayofmonth(local)))


def iso_day(ms: Column, zone: str = "UTC") -> Column:
    return F.date_format(to_local(ms, zone), "yyyy-MM-dd")


def ceil_tick(ms: Column, unit: str, zone: str = "UTC") -> Column:
    """``ms`` if it begins a unit, else the start of the next one."""
    start = bucket(ms, unit, zone)
    if unit == "HOURS":
        return F.when(start == ms, ms).otherwise(start + HOUR_MS)
    after = local_start(to_local(ms, zone), unit) + F.expr(f"interval {_STEP[unit]}")
    return F.when(start == ms, ms).otherwise(to_ms(after, zone))
