"""Coupon-alert queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsecart.operators import alerts as AL
from pulsecart.plans.settings import ALERT_BUCKET, ALERT_SLIDE, ALERT_WINDOW
from pulsecart.sources import adapters
from pulsecart.sources.tables import read_table


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.event_log(read_table(spark, sf, "events"))


def flat(alerts: DataFrame) -> DataFrame:
    """Alert rows with the lists as texts."""
    return alerts.select(
        "alert_id", "mid", "ts", "dt",
        *[F.array_join(c, ",").alias(c) for c in ("uids", "itemIds", "events")],
    )


def alert_windows(spark, sf):
    return flat(AL.coupon_alerts(_events(spark, sf), ALERT_WINDOW, ALERT_SLIDE))


def alert_throttled(spark, sf):
    return flat(
        AL.coupon_alerts(_events(spark, sf), ALERT_WINDOW, ALERT_SLIDE, bucket=ALERT_BUCKET)
    )


def alert_qualifying(spark, sf):
    windows = AL.qualifying_windows(_events(spark, sf), ALERT_WINDOW, ALERT_SLIDE)
    return windows.select("mid", F.unix_millis("window.end").alias("ts"))


def alert_live_shape(spark, sf):
    """The live window of 5 minutes and slide of 5 seconds, on times that run 72 times as fast, so that
    a window holds as many events as one of 6 hours."""
    faster = F.timestamp_millis(F.expr(f"{START_MS} + (unix_millis(ts) - {START_MS}) div {FASTER}"))
    events = adapters.event_log(read_table(spark, sf, "events").withColumn("ts", faster))
    windows = AL.qualifying_windows(events, "5 minutes", "5 seconds")
    return windows.select("mid", F.unix_millis("window.end").alias("ts"))


QUERIES = {
    "alert_live_shape": alert_live_shape,
    "alert_windows": alert_windows,
    "alert_throttled": alert_throttled,
    "alert_qualifying": alert_qualifying,
}

START_MS, FASTER = 1704067200000, 72  # 2024-01-01

ALERTS = """
log AS (
  SELECT (user_id // 15)::VARCHAR AS mid, user_id::VARCHAR AS uid,
         CASE event_type WHEN 'purchase' THEN 'coupon' WHEN 'click' THEN 'clickItem'
              ELSE event_type END AS evid,
         json_extract_string(props, '$.k') AS itemid, epoch(date_trunc('hour', ts))::BIGINT AS h
  FROM events),
placed AS (SELECT log.*, (h + k * 3600) AS w_end FROM log, unnest(range(1, 7)) AS g(k)),
alerts AS (
  SELECT mid, w_end * 1000 AS ts,
         array_to_string(list_sort(list(DISTINCT uid) FILTER (evid = 'coupon')), ',') AS uids,
         array_to_string(list_sort(list(DISTINCT itemid) FILTER (evid = 'coupon')), ',') AS "itemIds",
         array_to_string(list_sort(list(evid)), ',') AS events
  FROM placed GROUP BY mid, w_end
  HAVING count(DISTINCT uid) FILTER (evid = 'coupon') >= 3 AND NOT bool_or(evid = 'clickItem')),
named AS (
  SELECT *, strftime(make_timestamp(ts * 1000), '%Y-%m-%d') AS dt FROM alerts)"""

SQL = {
    "alert_live_shape": f"""WITH fast AS (
          SELECT (user_id // 15)::VARCHAR AS mid, user_id, event_type,
                 ({START_MS} + ((epoch_us(ts) // 1000) - {START_MS}) // {FASTER}) // 5000 AS slot FROM events),
        placed AS (SELECT fast.*, (slot + k) * 5000 AS ts FROM fast, unnest(range(1, 61)) AS g(k))
        SELECT mid, ts FROM placed GROUP BY mid, ts
        HAVING count(DISTINCT user_id) FILTER (event_type = 'purchase') >= 3 AND NOT bool_or(event_type = 'click')""",
    "alert_windows": f"""WITH {ALERTS}
        SELECT mid || '_' || (ts // 60000)::VARCHAR AS alert_id, * FROM named""",
    "alert_throttled": f"""WITH {ALERTS}
        SELECT mid || '_' || (ts // 10800000)::VARCHAR AS alert_id, * FROM named
        QUALIFY row_number() OVER (PARTITION BY mid, ts // 10800000 ORDER BY ts DESC) = 1""",
    "alert_qualifying": f"WITH {ALERTS} SELECT mid, ts FROM alerts",
}
