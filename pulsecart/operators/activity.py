"""Daily active devices: dedup, totals, hours, day over day, indicators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pulsecart.functions import day_before, day_text, hour_spine, hour_text
from pulsecart.operators.keyed import first_by
from pulsecart.schemas import DAILY_ACTIVE_COLUMNS, KPI_DAILY_ACTIVE, KPI_NEW_DEVICES

DEVICE_DAY = ["mid", "logdate"]


def active_behaviour(behaviour: DataFrame) -> DataFrame:
    """Records that open the application: a start, or a page that no page led to."""
    return behaviour.filter(
        F.col("start").isNotNull() | (F.col("page").isNotNull() & F.col("last_page_id").isNull())
    )


def first_rows(startup: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """The earliest startup of each device and day, as a row of the daily-active table."""
    columns = [*DAILY_ACTIVE_COLUMNS, *tie]
    return first_by(startup.select(*columns), DEVICE_DAY, ["ts", *tie]).select(*DAILY_ACTIVE_COLUMNS)


def without_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose device is not yet in the seen set of their day."""
    return rows.join(seen.select(*DEVICE_DAY), DEVICE_DAY, "left_anti").select(*rows.columns)


def seen_devices(startup: DataFrame) -> DataFrame:
    """The seen set: each device once per day."""
    return startup.select(*DEVICE_DAY).distinct()


def newly_active(startup: DataFrame, seen: DataFrame, tie: Sequence[str] = ()) -> DataFrame:
    """First rows of the devices that the seen set does not hold.

    Dropping seen devices and taking first rows commute. Aggregating first leaves one row per
    device and day, already placed for the join.
    """
    return without_seen(first_rows(startup, tie), seen)


def first_times(startup: DataFrame) -> DataFrame:
    """Device, ``day`` and first ``event_time``: the part of the first rows that counting needs.

    Grouped on fixed-width values with a primitive minimum, this stays a hash aggregate.
    """
    day = F.to_date("event_time").alias("day")
    return startup.groupBy("mid", day).agg(F.min("event_time").alias("event_time"))


def as_log_rows(times: DataFrame) -> DataFrame:
    """``mid``, ``logdate``, ``loghour`` of first times."""
    return times.select("mid", day_text("day").alias("logdate"), hour_text("event_time").alias("loghour"))


def total(daily: DataFrame, day: str) -> DataFrame:
    """Active devices of a day."""
    return daily.filter(F.col("logdate") == day).agg(F.count("*").alias("total"))


def totals(daily: DataFrame) -> DataFrame:
    """Active devices of every day."""
    return daily.groupBy("logdate").agg(F.count("*").alias("total"))


def by_hour(daily: DataFrame, day: str) -> DataFrame:
    """Active devices of a day by hour of their first startup; hours without any are absent."""
    return daily.filter(F.col("logdate") == day).groupBy("loghour").agg(F.count("*").alias("ct"))


def hour_map(daily: DataFrame, day: str) -> DataFrame:
    """:func:`by_hour` as one map from hour to count."""
    entries = F.sort_array(F.collect_list(F.struct("loghour", "ct")))
    return by_hour(daily, day).agg(F.map_from_entries(entries).alias("hours"))


def today_vs_yesterday(daily: DataFrame, day: str) -> DataFrame:
    """Hourly counts of a day and the day before, always 24 rows.

    The empty hours come in as zero rows of the same aggregate, so both days and the zero fill
    need one pass and no join.
    """
    before = day_before(day)
    mark = lambda d: F.when(F.col("logdate") == d, 1).otherwise(0)
    rows = daily.filter(F.col("logdate").isin(day) | (F.col("logdate") == before)).select(
        "loghour", mark(day).alias("today"), mark(before).alias("yesterday")
    )
    zeros = hour_spine(daily.sparkSession).select(
        "loghour", F.lit(0).alias("today"), F.lit(0).alias("yesterday")
    )
    return rows.unionByName(zeros).groupBy("loghour").agg(
        F.sum("today").alias("today"), F.sum("yesterday").alias("yesterday")
    )


def stage_counts(startup: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows per day at the three stages: raw, device not seen before, one per device.

    Rows are counted per device and day before the seen set is joined.
    """
    devices = startup.groupBy(*DEVICE_DAY).agg(F.count("*").alias("n"))
    known = seen.select(*DEVICE_DAY).withColumn("known", F.lit(True))
    fresh = F.col("known").isNull()
    return (
        devices.join(known, DEVICE_DAY, "left")
        .groupBy("logdate")
        .agg(
            F.sum("n").alias("raw_rows"),
            F.sum(F.when(fresh, F.col("n")).otherwise(0)).alias("unseen_rows"),
            F.count_if(fresh).alias("unique_rows"),
        )
    )


def new_devices(daily: DataFrame) -> DataFrame:
    """Per day, the devices whose first active day it is."""
    first = daily.groupBy("mid").agg(F.min(F.to_date("logdate")).alias("day"))
    return first.groupBy(day_text("day").alias("logdate")).agg(F.count("*").alias("new_devices"))


def kpis(daily: DataFrame, day: str) -> DataFrame:
    """Indicator rows (id, name, value) of a day: new devices and active devices.

    ``daily`` holds all days up to ``day``; both indicators come from one aggregate per device.
    """
    active = F.to_date("logdate")
    device = (
        daily.filter(F.col("logdate") <= day)
        .groupBy("mid")
        .agg(F.min(active).alias("first"), F.max(active).alias("last"))
    )
    date = F.to_date(F.lit(day))
    counted = {
        KPI_NEW_DEVICES: F.count_if(F.col("first") == date),
        KPI_DAILY_ACTIVE: F.count_if(F.col("last") == date),
    }
    counts = device.agg(*[c.alias(kpi[0]) for kpi, c in counted.items()])
    rows = [
        F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"), F.col(i).alias("value"))
        for i, n in counted
    ]
    return counts.select(F.inline(F.array(*rows)))


def day_over_day(day_values: DataFrame, value: str = "total") -> DataFrame:
    """Change of a daily value against the day before.

    Every value counts for its own day and as yesterday of the next one, so one small aggregate
    replaces a window over all days. ``change`` is a fraction; null without a value yesterday or
    when that was 0.
    """
    none = F.lit(None).cast("bigint")
    own = day_values.select("logdate", F.col(value).alias("today"), none.alias("yesterday"))
    next_day = day_values.select(
        day_text(F.date_add(F.to_date("logdate"), 1)).alias("logdate"),
        none.alias("today"),
        F.col(value).alias("yesterday"),
    )
    both = own.unionByName(next_day).groupBy("logdate").agg(
        F.max("today").alias("today"), F.max("yesterday").alias("yesterday")
    )
    change = F.try_divide(F.col("today") - F.col("yesterday"), F.col("yesterday"))
    return both.filter(F.col("today").isNotNull()).withColumn("change", change)
