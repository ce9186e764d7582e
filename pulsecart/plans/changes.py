"""Change-record, upsert and record-format queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsecart.functions import age_years, bucket_id, create_parts, parse_records, split_corrupt
from pulsecart.operators import keyed
from pulsecart.operators.activity import DEVICE_DAY, first_rows
from pulsecart.operators.routing import ORDER_TOPIC, as_messages, routed
from pulsecart.plans.activity import FILLED
from pulsecart.plans.settings import AS_OF, BEFORE, DAY, TIE
from pulsecart.schemas import DAILY_ACTIVE_COLUMNS, ORDER_INFO, STARTUP_LOG
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.sinks.topics import write_topics
from pulsecart.sources import adapters
from pulsecart.sources.tables import read_table
from pulsecart.sources.topics import read_topic
from pulsecart.streaming.daily_active import daily_active_table
from pulsecart.workspace import run_folder

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]
LINE_COLUMNS = LINE_KEY + ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


def _records(spark: SparkSession, sf: str) -> DataFrame:
    orders = adapters.order_changes(read_table(spark, sf, "orders"))
    details = adapters.detail_changes(read_table(spark, sf, "lineitem"))
    users = adapters.user_change_records(read_table(spark, sf, "customer"))
    return orders.unionByName(details).unionByName(users)


def cdc_routed(spark, sf):
    cells = F.map_from_entries(F.transform("after", lambda c: F.struct(c["name"], c["value"])))
    return routed(_records(spark, sf)).select("topic", F.try_element_at(cells, F.lit("id")).alias("id"))


def cdc_topic_counts(spark, sf):
    return routed(_records(spark, sf)).groupBy("topic").agg(F.count("*").alias("messages"))


def cdc_after_image(spark, sf):
    """Order messages as JSON, read back through the record layout."""
    messages = as_messages(routed(adapters.order_changes(read_table(spark, sf, "orders"))))
    good, _ = split_corrupt(parse_records(messages, ORDER_INFO))
    return good.select("topic", "id", "order_status", "user_id", "total_amount", "create_time")


def cdc_topic_store(spark, sf):
    """The same through stored topics: routed, written, and one topic read and parsed."""
    folder = run_folder(spark, "topics")
    write_topics(as_messages(routed(_records(spark, sf))), folder)
    good, _ = split_corrupt(parse_records(read_topic(spark, folder, ORDER_TOPIC), ORDER_INFO))
    date, hour = create_parts("create_time")
    return good.select(
        "id", "total_amount", date.alias("create_date"), hour.alias("create_hour")
    )


def startup_json(spark, sf):
    """Startup records as JSON texts and back."""
    startup = adapters.startup_log(read_table(spark, sf, "events"))
    fields = [f.split()[0] for f in STARTUP_LOG.split(", ")]
    texts = startup.select("event_id", F.to_json(F.struct(*fields)).alias("value"))
    good, _ = split_corrupt(parse_records(texts, STARTUP_LOG))
    return good.select("event_id", "mid", "type", "ts")


def topic_corrupt(spark, sf):
    """Startup texts of which some are cut short: good records, and texts for the dead-letter output."""
    startup = adapters.startup_log(read_table(spark, sf, "events"))
    fields = [f.split()[0] for f in STARTUP_LOG.split(", ")]
    text = F.to_json(F.struct(*fields))
    cut = F.when(F.col("event_id") % 13 == 0, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value"))
    texts = startup.select("event_id", text.alias("value"))
    good, broken = split_corrupt(parse_records(texts.select(cut.alias("value")), STARTUP_LOG))
    count = lambda rows, name: rows.agg(F.lit(name).alias("output"), F.count("*").alias("rows"))
    return count(good, "records").unionByName(count(broken, "dead_letters"))


def upsert_null_ids(spark, sf):
    """Signups come without an id and are all kept; other events of a user replace each other. Two
    batches, and the first sent once more."""
    events = read_table(spark, sf, "events").select(
        F.when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("id"),
        (F.col("event_type") == "signup").alias("generated"), F.col("event_id").cast("bigint").alias("event_id"),
    )
    table = KeyedTable(spark, run_folder(spark, "null-ids"), events.schema, ["id"])
    for batch, n in ((0, 0), (1, 1), (0, 0)):
        table.write(events.filter(F.col("event_id") % 2 == n), "events", batch, ["event_id"])
    return table.read().groupBy("generated").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"))


def user_latest(spark, sf):
    changes = adapters.user_changes(read_table(spark, sf, "events"))
    return keyed.last_by(changes, ["id"], ["event_time", "event_id"]).select("id", "user_level")


def user_ages(spark, sf):
    users = adapters.user_info(read_table(spark, sf, "customer"))
    return users.select("id", "birthday", age_years("birthday", AS_OF).alias("age"))


def minute_ids(spark, sf):
    startup = adapters.startup_log(read_table(spark, sf, "events"))
    return startup.select("event_id", bucket_id("mid", "ts", 60).alias("alert_id"))


def _flat_lines(lines: DataFrame) -> DataFrame:
    return lines.select(
        *LINE_COLUMNS[:-1], F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate")
    )


def upsert_last_wins(spark, sf):
    lines = read_table(spark, sf, "lineitem").select(*LINE_COLUMNS)
    return _flat_lines(keyed.last_by(lines, LINE_KEY, LINE_ORDER))


def upsert_merge(spark, sf):
    """Returned lines put over the others by key."""
    lines = read_table(spark, sf, "lineitem").select(*LINE_COLUMNS, "l_returnflag")
    returned = F.col("l_returnflag") == "R"
    base = keyed.last_by(lines.filter(~returned), LINE_KEY, LINE_ORDER)
    changes = keyed.last_by(lines.filter(returned), LINE_KEY, LINE_ORDER)
    return _flat_lines(keyed.upsert(base, changes, LINE_KEY))


def upsert_table(spark, sf):
    """The same through a stored keyed table: two batches, and the first sent once more."""
    lines = read_table(spark, sf, "lineitem").select(*LINE_COLUMNS, "l_returnflag")
    returned = F.col("l_returnflag") == "R"
    schema = lines.select(*LINE_COLUMNS).schema
    table = KeyedTable(spark, run_folder(spark, "lines"), schema, LINE_KEY)
    table.write(lines.filter(~returned), "lines", 0, LINE_ORDER)
    table.write(lines.filter(returned), "lines", 1, LINE_ORDER)
    table.write(lines.filter(~returned), "lines", 0, LINE_ORDER)
    return _flat_lines(table.read())


def _daily_active_table(spark: SparkSession, sf: str) -> KeyedTable:
    table = daily_active_table(spark, run_folder(spark, "daily-active"))
    startup = adapters.startup_log(read_table(spark, sf, "events"))
    table.write(first_rows(startup, TIE).select(*DAILY_ACTIVE_COLUMNS), "daily", 0, unique=True)
    return table


def daily_active_scan(spark, sf):
    """The daily-active table stored by day, and one day of it read."""
    return _daily_active_table(spark, sf).read(days=[DAY], columns=FILLED).select(*FILLED)


def daily_active_sql(spark, sf):
    """The stored table asked in SQL: a day and the one before for all hours, with a total."""
    stored = _daily_active_table(spark, sf).read(days=[BEFORE, DAY])
    return spark.sql(
        """
        WITH clock AS (SELECT lpad(id, 2, '0') AS hour FROM range(24)),
        seen AS (
          SELECT loghour, count_if(logdate = {day}) AS today, count_if(logdate = {before}) AS yesterday
          FROM {stored} WHERE logdate IN ({day}, {before}) GROUP BY loghour)
        SELECT coalesce(hour, 'all') AS hour, sum(coalesce(today, 0)) AS today, sum(coalesce(yesterday, 0)) AS yesterday
        FROM clock LEFT JOIN seen ON loghour = hour GROUP BY ROLLUP (hour)
        """,
        stored=stored, day=DAY, before=BEFORE,
    )


def seen_set(spark, sf):
    startup = adapters.startup_log(read_table(spark, sf, "events"))
    return startup.select(*DEVICE_DAY).distinct()


QUERIES = {
    "cdc_routed": cdc_routed,
    "cdc_topic_counts": cdc_topic_counts,
    "cdc_after_image": cdc_after_image,
    "cdc_topic_store": cdc_topic_store,
    "startup_json": startup_json,
    "topic_corrupt": topic_corrupt,
    "upsert_null_ids": upsert_null_ids,
    "user_latest": user_latest,
    "user_ages": user_ages,
    "minute_ids": minute_ids,
    "upsert_last_wins": upsert_last_wins,
    "upsert_merge": upsert_merge,
    "upsert_table": upsert_table,
    "daily_active_scan": daily_active_scan,
    "daily_active_sql": daily_active_sql,
    "seen_set": seen_set,
}

_KEPT = "{k} % 11 <> 0 AND {k} % 7 <> 0 AND {k} % 5 <> 0"
_ORDER_KEPT = _KEPT.format(k="o_orderkey")
_ROUTED = f"""routed AS (
  SELECT 'order_info' AS topic, o_orderkey::VARCHAR AS id FROM orders WHERE {_ORDER_KEPT}
  UNION ALL
  SELECT 'order_detail', concat_ws('-', l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'),
         l_partkey, l_suppkey) FROM lineitem WHERE {_KEPT.format(k="l_orderkey")}
  UNION ALL
  SELECT 'user_info', c_custkey::VARCHAR FROM customer
  WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0)"""
USER_LATEST = """SELECT user_id::VARCHAR AS id, event_type AS user_level FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
_LINES = """l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    strftime(l_shipdate, '%Y-%m-%d') AS shipdate"""
_LAST = "l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC"
_MERGED = f"""SELECT {_LINES} FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY (l_returnflag = 'R') DESC, {_LAST}) = 1"""
FIRST_ROWS = """SELECT user_id::VARCHAR AS mid, user_id::VARCHAR AS uid, event_type AS type,
      strftime(ts, '%Y-%m-%d') AS logdate, strftime(ts, '%H') AS loghour, (epoch_us(ts) // 1000) AS ts
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY (epoch_us(ts) // 1000), event_id) = 1"""

SQL = {
    "cdc_routed": f"WITH {_ROUTED} SELECT * FROM routed",
    "cdc_topic_counts": f"WITH {_ROUTED} SELECT topic, count(*) AS messages FROM routed GROUP BY topic",
    "cdc_after_image": f"""SELECT 'order_info' AS topic, o_orderkey::VARCHAR AS id,
        o_orderstatus AS order_status, o_custkey::VARCHAR AS user_id, o_totalprice AS total_amount,
        strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS create_time FROM orders WHERE {_ORDER_KEPT}""",
    "cdc_topic_store": f"""SELECT o_orderkey::VARCHAR AS id, o_totalprice AS total_amount,
        strftime(o_orderdate, '%Y-%m-%d') AS create_date, strftime(o_orderdate, '%H') AS create_hour
        FROM orders WHERE {_ORDER_KEPT}""",
    "startup_json": """SELECT event_id, user_id::VARCHAR AS mid, event_type AS type, (epoch_us(ts) // 1000) AS ts
        FROM events""",
    "topic_corrupt": """SELECT CASE WHEN event_id % 13 = 0 THEN 'dead_letters' ELSE 'records' END AS output,
        count(*) AS rows FROM events GROUP BY 1""",
    "upsert_null_ids": """WITH rows AS (
          SELECT event_type = 'signup' AS generated,
                 CASE WHEN event_type = 'signup' THEN 'e' || event_id::VARCHAR ELSE 'u' || user_id::VARCHAR END AS id
          FROM events)
        SELECT generated, count(DISTINCT id) AS rows, count(DISTINCT id) AS ids FROM rows GROUP BY generated""",
    "user_latest": USER_LATEST,
    "user_ages": """WITH u AS (SELECT c_custkey::VARCHAR AS id,
          DATE '1955-01-01' + (c_custkey * 37 % 20000)::INTEGER AS d FROM customer)
        SELECT id, strftime(d, '%Y-%m-%d') AS birthday,
          (datediff('day', d, DATE '2024-02-01') // 365)::INTEGER AS age FROM u""",
    "minute_ids": """SELECT event_id, user_id::VARCHAR || '_' || ((epoch_us(ts) // 1000) // 60000)::VARCHAR AS alert_id
        FROM events""",
    "upsert_last_wins": f"""SELECT {_LINES} FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LAST}) = 1""",
    "upsert_merge": _MERGED,
    "upsert_table": _MERGED,
    "daily_active_scan": f"SELECT * FROM ({FIRST_ROWS}) WHERE logdate = '{DAY}'",
    "daily_active_sql": f"""WITH first_rows AS ({FIRST_ROWS}),
        filled AS (
          SELECT lpad(h::VARCHAR, 2, '0') AS hour, count(*) FILTER (logdate = '{DAY}') AS today,
                 count(*) FILTER (logdate = '{BEFORE}') AS yesterday
          FROM range(24) AS clock(h) LEFT JOIN first_rows ON loghour::INTEGER = h GROUP BY h)
        SELECT * FROM filled
        UNION ALL SELECT 'all', sum(today)::BIGINT, sum(yesterday)::BIGINT FROM filled""",
    "seen_set": """SELECT DISTINCT user_id::VARCHAR AS mid, strftime(ts, '%Y-%m-%d') AS logdate
        FROM events""",
}
