"""The operators run as streams over the retail tables, to the end of the available data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsecart.operators import activity
from pulsecart.operators.routing import ORDER_TOPIC
from pulsecart.operators.sales import wide_rows, with_user
from pulsecart.plans import alerts as batch_alerts
from pulsecart.plans.activity import FILLED
from pulsecart.plans.changes import FIRST_ROWS, USER_LATEST, SQL as CHANGES_SQL
from pulsecart.plans.sales import DETAIL_ID, SALES, with_product_fields
from pulsecart.plans.settings import (
    ALERT_BUCKET,
    ALERT_SLIDE,
    ALERT_WINDOW,
    ARRIVAL_LIFE,
    AS_OF,
    SEEN_FOR,
    TIE,
    TOLERANCE,
)
from pulsecart.schemas import ORDER_INFO
from pulsecart.sources import adapters
from pulsecart.sources.tables import LAYOUT, read_table, stream_table
from pulsecart.sources.topics import stream_topic
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.sinks.outcomes import write_items
from pulsecart.sinks.preview import PREVIEW_ROWS
from pulsecart.streaming import alerts, changes, daily_active, gmv, sales, users
from pulsecart.streaming.arrival_batches import arrival_sink, arrivals_of
from pulsecart.streaming.fan_out import fan_out
from pulsecart.streaming.runtime import ROWS_AT_ONCE, UNCOUNTED, drain, drain_to_files
from pulsecart.streaming.sale_batches import both_sides, holding_sink
from pulsecart.workspace import materialise, run_folder

DELAY = "1 hour"


def _startup(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.startup_log(stream_table(spark, sf, "events"))


def stream_dau(spark, sf):
    """All days, the open one included: every batch puts the earliest rows so far into the table."""
    return _dau_table(spark, _startup(spark, sf), run_folder(spark, "stream-dau")).select(*FILLED)


def _dau_table(spark: SparkSession, startup: DataFrame, folder: str) -> DataFrame:
    table = daily_active.daily_active_table(spark, f"{folder}/table")
    rows = daily_active.earliest_so_far(startup, DELAY, TIE)
    writer = rows.writeStream.outputMode("update").foreachBatch(table.upsert_batches("startup"))
    drain(writer, f"{folder}/checkpoint", UNCOUNTED)
    return table.read(columns=FILLED)


def _reach(spark: SparkSession, sf: str, name: str, time: str) -> tuple[int, int]:
    """First and last time of a table, in microseconds."""
    return tuple(read_table(spark, sf, name).agg(F.unix_micros(F.min(time)), F.unix_micros(F.max(time))).first())


def _in_slices(rows: DataFrame, time: str, reach: tuple[int, int], parts: int, n: int) -> DataFrame:
    """The n-th of equal parts of a stretch of time; rows beyond it are in the first or last part."""
    first, last = reach
    at = F.expr(f"(unix_micros({time}) - {first}) * {parts} div {max(1, last - first)}")
    return rows.where(F.least(F.greatest(at, F.lit(0)), F.lit(parts - 1)) == n)


def _put(rows: DataFrame, folder: str) -> None:
    """A slice of a table as more files of a stream, each task with its own file."""
    rows.write.mode("append").parquet(folder)


def _grown(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """The files put so far as a stream; a run over available data takes the new ones in one batch."""
    return spark.readStream.schema(LAYOUT[name]).parquet(f"{folder}/{name}")


DAU_SLICES, FAN_SLICES, SALE_SLICES = 5, 4, 3


def stream_dau_batches(spark, sf):
    """The same from five batches, one slice of time each, with a restart after every batch."""
    folder = run_folder(spark, "stream-dau-batches")
    events, reach = read_table(spark, sf, "events"), _reach(spark, sf, "events", "ts")
    found = None
    for n in range(DAU_SLICES):
        _put(_in_slices(events, "ts", reach, DAU_SLICES, n), f"{folder}/events")
        found = _dau_table(spark, adapters.startup_log(_grown(spark, "events", folder)), folder)
    return found.select(*FILLED)


def stream_dau_state(spark, sf):
    """The first rows with Python state, in one batch."""
    rows = daily_active.first_batch(_startup(spark, sf), TIE)
    return drain_to_files(rows, "stream-dau-state", UNCOUNTED).select(*FILLED)


def stream_seen_set(spark, sf):
    """What the state of that stream holds as seen at the end: devices whose first row is at most a day old."""
    folder = run_folder(spark, "stream-seen")
    rows = daily_active.first_batch(_startup(spark, sf), TIE, SEEN_FOR)
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
    drain(writer, f"{folder}/checkpoint", UNCOUNTED)
    _, last = _reach(spark, sf, "events", "ts")
    return daily_active.seen_set(spark, f"{folder}/checkpoint", (last or 0) // 1000)


def stream_fan_out(spark, sf):
    """Stage counts, a preview and the daily table from one pass over each batch.

    Rows: the output, the batch (none for the table), an item of the output and its number.
    """
    folder = run_folder(spark, "stream-fan-out")
    events, reach = read_table(spark, sf, "events"), _reach(spark, sf, "events", "ts")
    table = daily_active.daily_active_table(spark, f"{folder}/table")
    entry = "batch bigint, item string, n bigint"
    counts = KeyedTable(spark, f"{folder}/counts", f"{entry}, id string", ["id"])
    preview = KeyedTable(spark, f"{folder}/preview", f"{entry}, id string", ["id"])

    def derive(batch: DataFrame) -> dict[str, DataFrame]:
        days = [r[0] for r in batch.select("logdate").distinct().collect()]
        unseen = batch.join(table.written_keys(days).distinct(), daily_active.DEVICE_DAY, "left_anti")
        return {"raw": batch, "unseen": unseen, "first": activity.first_rows(unseen, TIE)}

    def stored(rows: DataFrame, batch_id: int) -> DataFrame:
        id_text = F.concat_ws("-", F.lit(str(batch_id)), "item")
        return rows.select(F.lit(batch_id).cast("bigint").alias("batch"), "item", F.col("n").cast("bigint").alias("n"), id_text.alias("id"))

    def count(frames, batch_id):
        one = lambda name: frames[name].agg(F.lit(name).alias("item"), F.count("*").alias("n"))
        rows = one("raw").unionByName(one("unseen")).unionByName(one("first"))
        counts.write(stored(rows, batch_id), "counts", batch_id, unique=True)

    def show(frames, batch_id):
        rows = frames["first"].orderBy("ts", "mid").limit(PREVIEW_ROWS)
        preview.write(stored(rows.select(F.concat_ws(" ", "mid", "logdate").alias("item"), F.col("ts").alias("n")), batch_id), "preview", batch_id, unique=True)

    def store(frames, batch_id):
        table.write(frames["first"], "startup", batch_id, unique=True)

    sink = fan_out(spark, folder, {"counts": count, "preview": show, "table": store}, derive)
    for n in range(FAN_SLICES):
        _put(_in_slices(events, "ts", reach, FAN_SLICES, n), f"{folder}/events")
        startup = adapters.startup_log(_grown(spark, "events", folder))
        drain(startup.writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    by_day = table.read(columns=["logdate"]).groupBy("logdate").agg(F.count("*").alias("n"))
    named = lambda rows, output: rows.select(F.lit(output).alias("output"), "batch", "item", "n")
    return (
        named(counts.read(), "counts").unionByName(named(preview.read(), "preview"))
        .unionByName(named(by_day.select(F.lit(None).cast("bigint").alias("batch"), F.col("logdate").alias("item"), "n"), "table"))
    )


def stream_dau_arrival(spark, sf):
    """Which row is kept is left open on arrival, so only device and day are returned."""
    rows = daily_active.on_arrival(_startup(spark, sf), "40 days")
    return drain_to_files(rows, "stream-dau-arrival").select("mid", "logdate")


def stream_dau_first_batch(spark, sf):
    folder = run_folder(spark, "stream-dau-first")
    table = daily_active.daily_active_table(spark, f"{folder}/table")
    sink = daily_active.first_batch_sink(table, "startup", TIE)
    drain(_startup(spark, sf).writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    return table.read(columns=FILLED).select(*FILLED)


def _alerts(spark: SparkSession, sf: str, bucket: str, label: str) -> DataFrame:
    folder = run_folder(spark, label)
    events = adapters.event_log(stream_table(spark, sf, "events"))
    windows = alerts.live_windows(events, DELAY, ALERT_WINDOW, ALERT_SLIDE)
    table = alerts.alert_table(spark, f"{folder}/table")
    stored = lambda: adapters.event_log(read_table(spark, sf, "events"))
    sink = alerts.describing_sink(table, stored, "alerts", ALERT_WINDOW, ALERT_SLIDE, bucket)
    drain(windows.writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    return batch_alerts.flat(table.read())


def stream_alerts(spark, sf):
    return _alerts(spark, sf, "1 minute", "stream-alerts")


def stream_alerts_throttled(spark, sf):
    return _alerts(spark, sf, ALERT_BUCKET, "stream-alerts-throttled")


def _live_sales(spark: SparkSession, sf: str) -> DataFrame:
    orders = adapters.order_info(stream_table(spark, sf, "orders"))
    details = adapters.order_detail_keys(stream_table(spark, sf, "lineitem"))
    pairs = sales.live_pairs(orders, details, TOLERANCE)
    return wide_rows(with_product_fields(pairs, read_table(spark, sf, "part")))


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.user_info(read_table(spark, sf, "customer"))


def stream_sale_detail(spark, sf):
    """Two-stream join with the buyer looked up in the stream, into plain files."""
    enriched = with_user(_live_sales(spark, sf), _users(spark, sf), AS_OF)
    return drain_to_files(enriched, "stream-sales", ROWS_AT_ONCE)


def _sale_slices(spark: SparkSession, sf: str, folder: str, shift_days: int = 0):
    """Put orders and details into their folders, slice by slice of time. Details are cut ``shift_days`` later than
    orders, so that a batch of details holds some that are older than orders of the batch before."""
    first, last = _reach(spark, sf, "orders", "o_orderdate")
    later = shift_days * 86_400_000_000
    for n in range(SALE_SLICES):
        orders, details = read_table(spark, sf, "orders"), read_table(spark, sf, "lineitem")
        _put(_in_slices(orders, "o_orderdate", (first, last), SALE_SLICES, n), f"{folder}/orders")
        _put(_in_slices(details, "l_shipdate", (first + later, last + later), SALE_SLICES, n), f"{folder}/lineitem")
        yield n


def stream_sale_detail_late(spark, sf):
    """The join over three batches, with a restart after each, and details up to 20 days later than orders. The
    delay covers that and the tolerance, so no row is too late and older rows are not held."""
    folder = run_folder(spark, "stream-sales-late")
    out, delay = f"{folder}/rows", "60 days"

    def pair(orders, details, batch_id):
        pairs = sales.live_pairs(orders, details, TOLERANCE, delay=delay)
        rows = wide_rows(with_product_fields(pairs, read_table(pairs.sparkSession, sf, "part")))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    sink = holding_sink(folder, pair, adapters.order_info, adapters.order_detail_keys, TOLERANCE, delay)
    for _ in _sale_slices(spark, sf, folder, shift_days=20):
        orders = _grown(spark, "orders", folder).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
        details = _grown(spark, "lineitem", folder).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate")
        rows = both_sides(orders, details, "o_orderdate", "l_shipdate")
        drain(rows.writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    schema = "order_detail_id string, order_id string, order_status string, create_time string, user_id string, sku_id string, sku_price double, sku_name string, dt string"
    return spark.read.schema(f"{schema}, batch bigint").parquet(out).drop("batch")


def stream_sale_arrival(spark, sf):
    """The join by arrival, where a side is remembered from its last arrival on, over three batches."""
    folder = run_folder(spark, "stream-sales-arrival")

    def write(pairs, batch_id):
        rows = pairs.select("o_id", "o_order_status", "o_user_id", "d_id", "d_sku_id", F.col("d_sku_num").cast("string").alias("d_sku_num"))
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    sink = arrival_sink(folder, write, ARRIVAL_LIFE, clock="transport")
    for _ in _sale_slices(spark, sf, folder):
        orders = adapters.order_info(_grown(spark, "orders", folder))
        details = adapters.order_detail_keys(_grown(spark, "lineitem", folder))
        drain(arrivals_of(orders, details).writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    schema = "o_id string, o_order_status string, o_user_id string, d_id string, d_sku_id string, d_sku_num string"
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/rows").drop("batch")


def _value_changes(orders: DataFrame) -> DataFrame:
    """Every order is inserted; by its key it is also updated (a tenth more, two hours later) or deleted."""
    amount = F.col("o_totalprice")
    order = lambda money, hours: F.struct(
        F.col("o_orderkey").cast("string").alias("id"),
        F.date_format(F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(hours)), adapters.TIME_FORMAT).alias("create_time"),
        money.alias("total_amount"),
    )
    none, first, later = F.lit(None).cast(gmv.ORDER), order(amount, 0), order(F.round(amount * 1.1, 2), 2)
    change = lambda before, after: F.struct(before.cast(gmv.ORDER).alias("before"), after.cast(gmv.ORDER).alias("after"))
    key = F.col("o_orderkey")
    more = F.when(key % 7 == 0, F.array(change(first, none))).when(key % 5 == 0, F.array(change(first, later)))
    return orders.select(F.inline(F.concat(F.array(change(none, first)), F.coalesce(more, F.array().cast(f"array<struct<before:{gmv.ORDER},after:{gmv.ORDER}>>")))))


def stream_gmv(spark, sf):
    """Order value by hour from a stream of inserts, updates and deletes, over three batches with a restart after each.
    Changes come in no order: some updates and deletes come batches before or after their insert."""
    folder = run_folder(spark, "stream-gmv")
    changes = materialise(_value_changes(read_table(spark, sf, "orders")), "order-changes")
    table = gmv.value_table(spark, f"{folder}/table")
    for n in range(SALE_SLICES):
        _put(changes.where(F.pmod(F.xxhash64("before", "after"), F.lit(SALE_SLICES)) == n), f"{folder}/changes")
        stream = spark.readStream.schema(changes.schema).parquet(f"{folder}/changes")
        writer = gmv.gross_value_so_far(stream).writeStream.outputMode("update").foreachBatch(table.upsert_batches("gmv"))
        drain(writer, f"{folder}/checkpoint")
    return gmv.current_value(table)


def bulk_outcomes(spark, sf):
    """Two bulk writes of event documents, some of them unfit: what became of each item."""
    number = F.col("event_id")
    events = read_table(spark, sf, "events").select(
        F.when(number % 101 == 0, F.repeat(F.lit("x"), F.lit(600)))
        .when(F.col("event_type") != "signup", F.col("user_id").cast("string")).alias("id"),
        F.when(number % 13 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(number % 17 != 0, F.col("event_type")).alias("kind"), number.cast("string").alias("seq"), number.alias("event_id"),
    )
    schema = "id string, amount double, kind string, seq bigint"
    table = KeyedTable(spark, run_folder(spark, "bulk"), schema, ["id"])
    found = [
        write_items(table, events.where(F.col("event_id") % 2 == batch), "events", batch, ["seq"], ["kind"])
        .select(F.lit(batch).cast("bigint").alias("batch"), "outcome", "reason", "items")
        for batch in (0, 1)
    ]
    return found[0].unionByName(found[1])


def stream_sale_table(spark, sf):
    """The same into the keyed table, with the buyers read anew for every batch.

    These orders are few a day over years, so the table is stored by month.
    """
    folder = run_folder(spark, "stream-sale-table")
    table = sales.sale_table(spark, f"{folder}/table", part_length=7)
    sink = sales.enriching_sink(table, lambda: _users(spark, sf), AS_OF, "sales")
    drain(_live_sales(spark, sf).writeStream.foreachBatch(sink), f"{folder}/checkpoint", ROWS_AT_ONCE)
    return table.read()


def stream_user_latest(spark, sf):
    folder = run_folder(spark, "stream-users")
    table = users.user_table(spark, f"{folder}/table", "id string, user_level string")
    sink = table.upsert_batches("users", order=["event_time", "event_id"])
    user_changes = adapters.user_changes(stream_table(spark, sf, "events"))
    drain(user_changes.writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    return table.read()


def stream_cdc_orders(spark, sf):
    """Order changes routed by one stream and read as records by a second one."""
    folder = run_folder(spark, "stream-cdc")
    records = adapters.order_changes(stream_table(spark, sf, "orders"))
    drain(changes.routing_writer(records, f"{folder}/topics"), f"{folder}/routing")
    topic = stream_topic(spark, f"{folder}/topics", ORDER_TOPIC)
    good, broken = changes.records_of(topic, ORDER_INFO)
    orders = drain_to_files(good, "stream-cdc-orders")
    if not drain_to_files(broken, "stream-cdc-broken").isEmpty():
        raise ValueError("routed records must parse")
    return orders.select(
        F.lit(ORDER_TOPIC).alias("topic"),
        "id", "order_status", "user_id", "total_amount", "create_time",
    )


QUERIES = {
    "stream_dau": stream_dau,
    "stream_dau_batches": stream_dau_batches,
    "stream_dau_arrival": stream_dau_arrival,
    "stream_dau_first_batch": stream_dau_first_batch,
    "stream_dau_state": stream_dau_state,
    "stream_seen_set": stream_seen_set,
    "stream_fan_out": stream_fan_out,
    "stream_alerts": stream_alerts,
    "stream_alerts_throttled": stream_alerts_throttled,
    "stream_sale_detail": stream_sale_detail,
    "stream_sale_detail_late": stream_sale_detail_late,
    "stream_sale_arrival": stream_sale_arrival,
    "stream_gmv": stream_gmv,
    "bulk_outcomes": bulk_outcomes,
    "stream_sale_table": stream_sale_table,
    "stream_user_latest": stream_user_latest,
    "stream_cdc_orders": stream_cdc_orders,
}

# The watermark is the latest event time less the delay; windows that end by then are closed.
_MARK = "(SELECT (epoch_us(max(ts)) // 1000) - 3600000 FROM events)"
_CLOSED = f"ts <= {_MARK}"

SQL = {
    "stream_dau": FIRST_ROWS,
    "stream_dau_batches": FIRST_ROWS,
    "stream_dau_arrival": f"SELECT mid, logdate FROM ({FIRST_ROWS})",
    "stream_dau_first_batch": FIRST_ROWS,
    "stream_dau_state": FIRST_ROWS,
    # A device and day counts as seen for 24 hours from its first row.
    "stream_seen_set": """SELECT mid, logdate, until FROM (
        SELECT user_id::VARCHAR AS mid, strftime(ts, '%Y-%m-%d') AS logdate,
               (epoch_us(min(ts)) // 1000 + 86400000)::BIGINT AS until
        FROM events GROUP BY 1, 2)
        WHERE until > (SELECT epoch_us(max(ts)) // 1000 FROM events)""",
    "stream_fan_out": f"""WITH reach AS (SELECT epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last FROM events),
        e AS (SELECT user_id::VARCHAR AS mid, strftime(ts, '%Y-%m-%d') AS logdate, epoch_us(ts) // 1000 AS ms,
                     least((epoch_us(ts) - first) * {FAN_SLICES} // greatest(1, last - first), {FAN_SLICES - 1})::BIGINT AS batch
              FROM events, reach),
        f AS (SELECT *, batch = min(batch) OVER (PARTITION BY mid, logdate) AS unseen,
                     row_number() OVER (PARTITION BY mid, logdate ORDER BY ms, batch) = 1 AS one FROM e),
        best AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY ms, mid) AS nth FROM f WHERE one)
        SELECT 'counts' AS output, batch, 'raw' AS item, count(*) AS n FROM f GROUP BY batch
        UNION ALL SELECT 'counts', batch, 'unseen', count(*) FILTER (unseen) FROM f GROUP BY batch
        UNION ALL SELECT 'counts', batch, 'first', count(*) FILTER (one) FROM f GROUP BY batch
        UNION ALL SELECT 'preview', batch, mid || ' ' || logdate, ms FROM best WHERE nth <= {PREVIEW_ROWS}
        UNION ALL SELECT 'table', NULL, logdate, count(*) FROM f WHERE one GROUP BY logdate""",
    "stream_alerts": f"""WITH {batch_alerts.ALERTS}
        SELECT mid || '_' || (ts // 60000)::VARCHAR AS alert_id, * FROM named WHERE {_CLOSED}""",
    "stream_alerts_throttled": f"""WITH {batch_alerts.ALERTS}
        SELECT mid || '_' || (ts // 10800000)::VARCHAR AS alert_id, * FROM named WHERE {_CLOSED}
        QUALIFY row_number() OVER (PARTITION BY mid, ts // 10800000, dt ORDER BY ts DESC) = 1""",
    "stream_sale_detail": f"WITH {SALES} SELECT * FROM enriched",
    "stream_sale_detail_late": f"WITH {SALES} SELECT * FROM sales",
    # Details before the order wait as long as none of the gaps up to the order reaches the lifetime.
    "stream_sale_arrival": f"""WITH a AS (
          SELECT o_orderkey, o_orderstatus, o_custkey, o_orderdate AS ordered, l_shipdate AS arrived,
                 {DETAIL_ID} AS d_id, l_partkey, l_quantity,
                 coalesce(lead(l_shipdate) OVER (PARTITION BY o_orderkey, l_shipdate < o_orderdate ORDER BY l_shipdate),
                          o_orderdate) AS next
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
        b AS (SELECT *, max(CASE WHEN next - arrived >= INTERVAL {ARRIVAL_LIFE} THEN 1 ELSE 0 END) OVER (
                PARTITION BY o_orderkey, arrived < ordered ORDER BY arrived
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS broken FROM a)
        SELECT o_orderkey::VARCHAR AS o_id, o_orderstatus AS o_order_status, o_custkey::VARCHAR AS o_user_id,
               d_id, l_partkey::VARCHAR AS d_sku_id, l_quantity::VARCHAR AS d_sku_num
        FROM b WHERE CASE WHEN arrived < ordered THEN broken = 0
                          ELSE arrived - ordered < INTERVAL {ARRIVAL_LIFE} END""",
    "stream_gmv": """WITH final AS (
          SELECT CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 2 HOURS ELSE o_orderdate END AS created,
                 CASE WHEN o_orderkey % 5 = 0 THEN round(o_totalprice * 1.1, 2) ELSE o_totalprice END AS amount
          FROM orders WHERE o_orderkey % 7 <> 0)
        SELECT strftime(created, '%Y-%m-%d') AS create_date, strftime(created, '%H') AS create_hour,
               sum(amount::DECIMAL(18, 2))::DOUBLE AS gmv, count(*) AS orders FROM final GROUP BY 1, 2""",
    "bulk_outcomes": """WITH e AS (
          SELECT event_id, event_id % 2 AS batch,
                 CASE WHEN event_id % 101 = 0 THEN repeat('x', 600) WHEN event_type <> 'signup' THEN user_id::VARCHAR END AS id,
                 CASE WHEN event_id % 101 = 0 THEN 'id too long' WHEN event_id % 17 = 0 THEN 'kind missing'
                      WHEN event_id % 13 = 0 THEN 'amount malformed' END AS reason
          FROM events),
        fit AS (SELECT *, id IS NULL OR event_id = max(event_id) OVER (PARTITION BY batch, id) AS last FROM e WHERE reason IS NULL),
        named AS (SELECT batch, CASE WHEN NOT last THEN 'replaced'
            WHEN id IS NOT NULL AND batch = 1 AND id IN (SELECT id FROM fit WHERE batch = 0 AND id IS NOT NULL) THEN 'updated'
            ELSE 'created' END AS outcome FROM fit)
        SELECT batch, outcome, NULL::VARCHAR AS reason, count(*) AS items FROM named GROUP BY ALL
        UNION ALL SELECT batch, 'rejected', reason, count(*) FROM e WHERE reason IS NOT NULL GROUP BY ALL""",
    "stream_sale_table": f"WITH {SALES} SELECT * FROM enriched",
    "stream_user_latest": USER_LATEST,
    "stream_cdc_orders": CHANGES_SQL["cdc_after_image"],
}
