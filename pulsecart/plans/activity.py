"""Daily-active queries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsecart.functions import day_before, day_text, within_days
from pulsecart.operators import activity as A
from pulsecart.plans.settings import DAY, TIE
from pulsecart.sinks.first_seen import FirstSeen
from pulsecart.sources import adapters
from pulsecart.sources.tables import read_table
from pulsecart.workspace import run_folder

# Columns of the daily-active table that the events table can fill.
FILLED = ["mid", "uid", "type", "logdate", "loghour", "ts"]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def _startup(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.startup_log(_events(spark, sf))


def _daily(spark: SparkSession, sf: str, first: str | None = None, last: str | None = None):
    """Daily-active rows in the narrow form; with days given, only their events are scanned."""
    events = _events(spark, sf)
    if last is not None:
        events = events.filter(within_days("ts", first or "0001-01-01", last))
    return A.as_log_rows(A.first_times(adapters.startup_log(events)))


def _halves(spark: SparkSession, sf: str):
    """The seen set of every morning, and the startups of every afternoon."""
    startup = _startup(spark, sf)
    morning = F.hour("event_time") < 12
    return A.seen_devices(startup.filter(morning)), startup.filter(~morning)


def active_behaviour(spark, sf):
    behaviour = adapters.behaviour_log(_events(spark, sf))
    return A.active_behaviour(behaviour).select(
        "event_id", "mid", "start", "page", day_text("event_time").alias("logdate")
    )


def dau_first_rows(spark, sf):
    return A.first_rows(_startup(spark, sf), TIE).select(*FILLED)


def dau_total(spark, sf):
    return A.total(_daily(spark, sf, DAY, DAY), DAY)


def dau_totals(spark, sf):
    return A.totals(_daily(spark, sf))


def dau_by_hour(spark, sf):
    return A.by_hour(_daily(spark, sf, DAY, DAY), DAY)


def dau_hour_map(spark, sf):
    hours = A.hour_map(_daily(spark, sf, DAY, DAY), DAY)
    at = lambda h: F.coalesce(F.try_element_at("hours", F.lit(h)), F.lit(0))
    return hours.select(
        F.size("hours").cast("bigint").alias("hours_active"),
        *[at(h).alias(f"h{h}") for h in ("00", "06", "12", "18")],
    )


def dau_today_vs_yesterday(spark, sf):
    from datetime import date, timedelta

    before = (date.fromisoformat(DAY) - timedelta(days=1)).isoformat()
    return A.today_vs_yesterday(_daily(spark, sf, before, DAY), DAY)


def dau_stage_counts(spark, sf):
    seen, rows = _halves(spark, sf)
    return A.stage_counts(rows, seen)


def dau_kpis(spark, sf):
    return A.kpis(_daily(spark, sf, None, DAY), DAY)


def dau_new_devices(spark, sf):
    return A.new_devices(_daily(spark, sf))


def dau_new_devices_kept(spark, sf):
    """The same from first days that are kept up over four batches, by the tens of days of a month, one of them late."""
    first = FirstSeen(spark, run_folder(spark, "first-seen"))
    tens = F.dayofmonth(F.to_date("logdate")) / 10
    for batch, ten in enumerate((0, 2, 1, 3)):
        first.merge(_daily(spark, sf).where(F.floor(tens) == ten), "daily", batch)
    return first.new_devices()


def dau_pct_change(spark, sf):
    return A.day_over_day(A.totals(_daily(spark, sf)))


def dau_anti_seen(spark, sf):
    seen, rows = _halves(spark, sf)
    return A.newly_active(rows, seen, TIE).select(*FILLED)


def dau_previous_days(spark, sf):
    return A.totals(_daily(spark, sf)).select(
        "logdate", day_before(F.col("logdate")).alias("previous")
    )


QUERIES = {
    "active_behaviour": active_behaviour,
    "dau_first_rows": dau_first_rows,
    "dau_total": dau_total,
    "dau_totals": dau_totals,
    "dau_by_hour": dau_by_hour,
    "dau_hour_map": dau_hour_map,
    "dau_today_vs_yesterday": dau_today_vs_yesterday,
    "dau_stage_counts": dau_stage_counts,
    "dau_kpis": dau_kpis,
    "dau_new_devices": dau_new_devices,
    "dau_new_devices_kept": dau_new_devices_kept,
    "dau_pct_change": dau_pct_change,
    "dau_anti_seen": dau_anti_seen,
    "dau_previous_days": dau_previous_days,
}

_LOG = """
log AS (
  SELECT user_id::VARCHAR AS mid, user_id::VARCHAR AS uid, event_type AS type,
         strftime(ts, '%Y-%m-%d') AS logdate, strftime(ts, '%H') AS loghour,
         (epoch_us(ts) // 1000) AS ts, event_id
  FROM events)"""
_RANKED = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY mid, logdate ORDER BY ts, event_id) AS rn
  FROM {source})"""
_DAILY = f"WITH {_LOG}, {_RANKED.format(source='log')}, daily AS (SELECT * FROM ranked WHERE rn = 1)"
_HALVES = f"""WITH {_LOG},
seen AS (SELECT DISTINCT mid, logdate FROM log WHERE loghour < '12'),
late AS (SELECT * FROM log WHERE loghour >= '12'),
unseen AS (SELECT l.* FROM late l
           WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.mid = l.mid AND s.logdate = l.logdate))"""
_TOTALS = "totals AS (SELECT logdate, count(*) AS total FROM daily GROUP BY logdate)"

SQL = {
    "active_behaviour": """
        SELECT event_id, user_id::VARCHAR AS mid,
               CASE WHEN event_type = 'signup' THEN value::VARCHAR END AS start,
               CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') END AS page,
               strftime(ts, '%Y-%m-%d') AS logdate
        FROM events WHERE event_type IN ('signup', 'view')""",
    "dau_first_rows": f"{_DAILY} SELECT mid, uid, type, logdate, loghour, ts FROM daily",
    "dau_total": f"{_DAILY} SELECT count(*) AS total FROM daily WHERE logdate = '{DAY}'",
    "dau_totals": f"{_DAILY}, {_TOTALS} SELECT * FROM totals",
    "dau_by_hour": f"""{_DAILY} SELECT loghour, count(*) AS ct FROM daily
        WHERE logdate = '{DAY}' GROUP BY loghour""",
    "dau_hour_map": f"""{_DAILY} SELECT count(DISTINCT loghour) AS hours_active,
        count(*) FILTER (loghour = '00') AS h00, count(*) FILTER (loghour = '06') AS h06,
        count(*) FILTER (loghour = '12') AS h12, count(*) FILTER (loghour = '18') AS h18
        FROM daily WHERE logdate = '{DAY}'""",
    "dau_today_vs_yesterday": f"""{_DAILY},
        spine AS (SELECT lpad(h::VARCHAR, 2, '0') AS loghour FROM range(24) r(h))
        SELECT s.loghour,
               count(*) FILTER (d.logdate = '{DAY}') AS today,
               count(*) FILTER (d.logdate::DATE = DATE '{DAY}' - 1) AS yesterday
        FROM spine s LEFT JOIN daily d
          ON d.loghour = s.loghour AND d.logdate::DATE BETWEEN DATE '{DAY}' - 1 AND DATE '{DAY}'
        GROUP BY s.loghour""",
    "dau_stage_counts": f"""{_HALVES},
        u AS (SELECT logdate, count(*) AS unseen_rows, count(DISTINCT mid) AS unique_rows
              FROM unseen GROUP BY logdate)
        SELECT l.logdate, count(*) AS raw_rows, coalesce(any_value(u.unseen_rows), 0) AS unseen_rows,
               coalesce(any_value(u.unique_rows), 0) AS unique_rows
        FROM late l LEFT JOIN u ON u.logdate = l.logdate GROUP BY l.logdate""",
    "dau_kpis": f"""{_DAILY}, first AS (SELECT mid, min(logdate) AS logdate FROM daily GROUP BY mid)
        SELECT 'new_mid' AS id, '新增设备' AS name, count(*) AS value FROM first WHERE logdate = '{DAY}'
        UNION ALL
        SELECT 'dau', '新增日活', count(*) FROM daily WHERE logdate = '{DAY}'""",
    "dau_new_devices": f"""{_DAILY}, first AS (SELECT mid, min(logdate) AS logdate FROM daily GROUP BY mid)
        SELECT logdate, count(*) AS new_devices FROM first GROUP BY logdate""",
    "dau_pct_change": f"""{_DAILY}, {_TOTALS}
        SELECT t.logdate, t.total AS today, y.total AS yesterday,
               (t.total - y.total) / nullif(y.total, 0)::DOUBLE AS change
        FROM totals t LEFT JOIN totals y ON y.logdate::DATE = t.logdate::DATE - 1""",
    "dau_anti_seen": f"""{_HALVES}, {_RANKED.format(source='unseen')}
        SELECT mid, uid, type, logdate, loghour, ts FROM ranked WHERE rn = 1""",
    "dau_previous_days": f"""{_DAILY} SELECT DISTINCT logdate,
        strftime(logdate::DATE - 1, '%Y-%m-%d') AS previous FROM daily""",
}
SQL["dau_new_devices_kept"] = SQL["dau_new_devices"]
