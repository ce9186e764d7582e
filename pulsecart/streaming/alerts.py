"""Coupon alerts on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsecart.operators.alerts import BUCKET, SLIDE, describe_windows, qualifying_stream
from pulsecart.schemas import ALERT_MIN_ACCOUNTS, ALERT_WINDOW
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.workspace import materialise

ALERT = (
    "alert_id string, mid string, uids array<string>, itemIds array<string>, "
    "events array<string>, ts bigint, dt string"
)


def live_windows(
    events: DataFrame,
    delay: str,
    window: str = ALERT_WINDOW,
    slide: str = SLIDE,
    min_accounts: int = ALERT_MIN_ACCOUNTS,
) -> DataFrame:
    """Closed device windows that raise an alert; events later than ``delay`` are dropped."""
    return qualifying_stream(events.withWatermark("event_time", delay), window, slide, min_accounts)


def describing_sink(
    table: KeyedTable,
    events: Callable[[], DataFrame],
    writer: str,
    window: str = ALERT_WINDOW,
    slide: str = SLIDE,
    bucket: str = BUCKET,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that turns found windows into alert records and upserts them.

    ``events`` gives the stored events; only those in the time of the found windows are read. A later
    alert of the same device and bucket replaces an earlier one.
    """

    def sink(windows: DataFrame, batch_id: int) -> None:
        windows = materialise(windows, "alert-windows")
        reach = windows.agg(F.min("window.start").alias("first"), F.max("window.end").alias("last")).first()
        if reach["first"] is None:
            return
        time = F.col("event_time")
        near = events().filter((time >= F.lit(reach["first"])) & (time < F.lit(reach["last"])))
        table.write(describe_windows(near, windows, window, slide, bucket), writer, batch_id, ["ts"])

    return sink


def alert_table(spark: SparkSession, path: str) -> KeyedTable:
    """Stored alerts by day. A later alert of the same device and minute replaces an earlier one;
    write batches with ``order=["ts"]``."""
    return KeyedTable(spark, path, ALERT, ["alert_id"], day_column="dt")
