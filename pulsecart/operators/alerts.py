"""Coupon-abuse alerts: many accounts on one device take coupons and none browses an item."""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, functions as F

from pulsecart.functions import bucket_id, day_text, equals_text, seconds_in, time_of
from pulsecart.operators.keyed import last_by
from pulsecart.schemas import (
    ALERT_COLUMNS,
    ALERT_MIN_ACCOUNTS,
    ALERT_WINDOW,
    BROWSE_EVENT,
    COUPON_EVENT,
)
from pulsecart.workspace import materialise

# One alert per device and minute, so by default windows end on minutes too.
SLIDE = "1 minute"
BUCKET = "1 minute"


def pane_length(window: str, slide: str) -> str:
    """The longest tile that both the window and its slide are multiples of."""
    return f"{gcd(seconds_in(window), seconds_in(slide))} seconds"


def _is_coupon() -> Column:
    return equals_text("evid", COUPON_EVENT)


def _is_browse() -> Column:
    return equals_text("evid", BROWSE_EVENT)


def _account() -> Column:
    return F.when(_is_coupon(), F.col("uid"))


def pane_votes(events: DataFrame, window: str, slide: str) -> DataFrame:
    """Coupon accounts per tile and device, and whether the device browsed; only these events count.

    Repeats collapse before rows are copied into overlapping windows, and one device's rows are
    spread over many keys.
    """
    return (
        events.filter(F.col("evid").isin(COUPON_EVENT, BROWSE_EVENT))
        .groupBy(
            F.window("event_time", pane_length(window, slide)).alias("pane"),
            "mid",
            _account().alias("account"),
        )
        .agg(F.max(_is_browse()).alias("browsed"))
    )


def qualifying_windows(
    events: DataFrame,
    window: str = ALERT_WINDOW,
    slide: str = SLIDE,
    min_accounts: int = ALERT_MIN_ACCOUNTS,
) -> DataFrame:
    """Device and ``window`` pairs that raise an alert.

    Reads only coupon and browse events, and counts distinct accounts without gathering them, so
    a device with a large part of all events never has to fit in one task.
    """
    return (
        pane_votes(events, window, slide).groupBy(F.window("pane", window, slide).alias("window"), "mid")
        .agg(F.count_distinct("account").alias("accounts"), F.max("browsed").alias("browsed"))
        .filter((F.col("accounts") >= min_accounts) & ~F.col("browsed"))
        .select("mid", "window")
    )


def last_window_per_bucket(windows: DataFrame, bucket: str = BUCKET) -> DataFrame:
    """Throttle: of the windows of a device that end in one bucket, the last."""
    number = F.floor(F.unix_seconds("window.end") / F.lit(seconds_in(bucket)))
    return (
        windows.withColumn("bucket", number)
        .groupBy("mid", "bucket")
        .agg(F.max("window").alias("window"))
        .select("mid", "window")
    )


def _alert_columns() -> list[Column]:
    """Aggregates over counted rows of one device window: accounts, items and event list."""
    listed = F.collect_list(F.struct("evid", F.col("n").cast("int").alias("n")))
    repeated = F.flatten(F.transform(listed, lambda e: F.array_repeat(e["evid"], e["n"])))
    return [
        F.sort_array(F.collect_set(_account())).alias("uids"),
        F.sort_array(F.collect_set(F.when(_is_coupon(), F.col("itemid")))).alias("itemIds"),
        F.sort_array(repeated).alias("events"),
    ]


def _named(alerts: DataFrame, bucket: str) -> DataFrame:
    ts = F.unix_millis("window.end")
    return (
        alerts.withColumn("ts", ts)
        .withColumn("alert_id", bucket_id("mid", "ts", seconds_in(bucket)))
        .withColumn("dt", day_text(time_of("ts")))
        .select(*ALERT_COLUMNS)
    )


def describe_windows(
    events: DataFrame, windows: DataFrame, window: str, slide: str, bucket: str
) -> DataFrame:
    """Alert records of the given device windows.

    Only events in tiles of these windows are gathered. ``windows`` should be a written result:
    Spark then knows its size and picks a broadcast or a shuffled join by it.
    """
    step = pane_length(window, slide)
    last = F.col("window.end") - F.expr(f"interval {step}")
    tiles = windows.select(
        "mid",
        "window",
        F.explode(F.sequence(F.col("window.start"), last, F.expr(f"interval {step}"))).alias("tile"),
    )
    rows = events.select(
        "mid", "evid", "uid", "itemid", F.window("event_time", step)["start"].alias("tile")
    )
    counted = (
        rows.join(tiles, ["mid", "tile"])
        .groupBy("window", "mid", "evid", "uid", "itemid")
        .agg(F.count("*").alias("n"))
    )
    return _named(counted.groupBy("window", "mid").agg(*_alert_columns()), bucket)


def coupon_alerts(
    events: DataFrame,
    window: str = ALERT_WINDOW,
    slide: str = SLIDE,
    min_accounts: int = ALERT_MIN_ACCOUNTS,
    bucket: str | None = None,
) -> DataFrame:
    """Alerts of a batch of events; with ``bucket`` at most one per device and bucket.

    Two passes, because alerts are rare: a narrow one finds the windows, and only their events
    are gathered in the second.
    """
    windows = qualifying_windows(events, window, slide, min_accounts)
    if bucket is not None:
        windows = last_window_per_bucket(windows, bucket)
    windows = materialise(windows, "alert-windows")
    return describe_windows(events, windows, window, slide, bucket or BUCKET)


def qualifying_stream(
    events: DataFrame,
    window: str = ALERT_WINDOW,
    slide: str = SLIDE,
    min_accounts: int = ALERT_MIN_ACCOUNTS,
) -> DataFrame:
    """:func:`qualifying_windows` of a watermarked event stream, each once its window is closed.

    State holds one flag for each account of a device and tile or window, and one counter for each
    device and window; no list, and nothing of events that are neither coupons nor browses.
    """
    voters = pane_votes(events, window, slide).groupBy(
        F.window("pane", window, slide).alias("window"), "mid", "account"
    ).agg(F.max("browsed").alias("browsed"))
    return (
        voters.groupBy("window", "mid")
        .agg(F.count("account").alias("accounts"), F.max("browsed").alias("browsed"))
        .filter((F.col("accounts") >= min_accounts) & ~F.col("browsed"))
        .select("mid", "window")
    )


def throttle(alerts: DataFrame) -> DataFrame:
    """At most one alert per ``alert_id``: the later one."""
    return last_by(alerts, ["alert_id"], ["ts"])
