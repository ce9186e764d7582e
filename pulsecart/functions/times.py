"""Dates, hours and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Formats of the derived date and hour texts.
DAY_FORMAT = "yyyy-MM-dd"
HOUR_FORMAT = "HH"

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def time_of(epoch_ms: Column | str) -> Column:
    """Epoch milliseconds as a timestamp."""
    return F.timestamp_millis(_col(epoch_ms))


def day_text(time: Column | str) -> Column:
    """``yyyy-MM-dd`` of a timestamp or date."""
    return F.date_format(_col(time), DAY_FORMAT)


def hour_text(time: Column | str) -> Column:
    """``00`` to ``23`` of a timestamp."""
    return F.date_format(_col(time), HOUR_FORMAT)


def create_parts(create_time: Column | str) -> tuple[Column, Column]:
    """Date and hour of a ``yyyy-MM-dd HH:mm:ss`` text; the texts are cut, not parsed."""
    text = _col(create_time)
    clock = F.split_part(text, F.lit(" "), F.lit(2))
    return F.split_part(text, F.lit(" "), F.lit(1)), F.split_part(clock, F.lit(":"), F.lit(1))


def day_before(day: Column | str) -> Column:
    """The previous day of a ``yyyy-MM-dd`` value, as text. A plain string is taken as a literal."""
    value = F.lit(day) if isinstance(day, str) else day
    return day_text(F.date_sub(F.to_date(value), 1))


def within_days(time: Column | str, first: str, last: str) -> Column:
    """True for times from the start of ``first`` to the end of ``last``.

    Written as a range on the raw timestamp so that it reaches the file scan, which an equality on
    a formatted date would not.
    """
    start = F.to_timestamp(F.lit(first))
    end = F.to_timestamp(F.date_add(F.to_date(F.lit(last)), 1))
    return (_col(time) >= start) & (_col(time) < end)


def seconds_in(interval: str) -> int:
    """Seconds in a simple interval text such as ``5 minutes``."""
    number, unit = interval.split()
    return int(number) * _UNIT_SECONDS[unit.rstrip("s").lower()]


def hour_spine(spark: SparkSession) -> DataFrame:
    """The 24 hours of a day as ``loghour`` texts."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(23)))
    return spark.range(1).select(hours.alias("h")).select(
        F.lpad(F.col("h").cast("string"), 2, "0").alias("loghour")
    )
