"""Streams over ordered files: golden cases, stream = batch, restart."""

import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feeds import Feed
from pulsecart.functions import day_text, hour_text, time_of
from pulsecart.operators import activity as A
from pulsecart.operators import alerts as AL
from pulsecart.operators import sales as SD
from pulsecart.schemas import ALERT_COLUMNS, DAILY_ACTIVE_COLUMNS, USER_INFO
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.sinks.preview import console_writer, counted, observed_counts
from pulsecart.sources import adapters
from pulsecart.sinks.topics import topics_writer
from pulsecart.sources.tables import LAYOUT
from pulsecart.sources.topics import read_topic
from pulsecart.streaming import alerts, changes, daily_active, sales, users
from pulsecart.streaming.runtime import drain, start
from pulsecart.workspace import run_folder

FOLDER = "/root/testdata/sf0.001"
T0 = 1705276800000
HOUR, DAY = 3_600_000, 86_400_000
RAW = "mid string, tie bigint, ts bigint"


def raw_stream(spark, folder):
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(folder))


def as_startup(df):
    text = lambda n: F.lit(None).cast("string").alias(n)
    return df.select(
        "mid", F.concat(F.lit("u"), "tie").alias("uid"),
        *[text(n) for n in ("appid", "area", "os", "ch", "type", "vs")],
        "ts", "tie", day_text(time_of("ts")).alias("logdate"), hour_text(time_of("ts")).alias("loghour"),
        time_of("ts").alias("event_time"),
    )


def startups(*rows):
    return pd.DataFrame(rows, columns=["mid", "tie", "ts"])


def to_table(spark, df, label):
    """Drain an append stream into files below a fixed checkpoint; returns a rerunnable reader."""
    folder = run_folder(spark, label)

    def run():
        writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
        drain(writer, f"{folder}/checkpoint")
        return spark.read.schema(df.schema).parquet(f"{folder}/rows")

    return run


@pytest.fixture
def feed(tmp_path):
    return Feed(tmp_path / "in")


def winners(df):
    return sorted((r["mid"], r["logdate"], r["uid"]) for r in df.collect())


# Within a batch, across batches with an earlier row later, and on the next day.
BATCHES = [
    [("a", 1, T0 + 50), ("a", 2, T0 + 10), ("b", 3, T0 + 99)],
    [("a", 4, T0 + 5), ("b", 5, T0 + DAY), ("c", 6, T0 + HOUR), ("c", 7, T0 + HOUR)],
    [("c", 8, T0 + 2 * DAY)],
]
FIRST_BATCH = [
    ("a", "2024-01-15", "u2"), ("b", "2024-01-15", "u3"), ("b", "2024-01-16", "u5"),
    ("c", "2024-01-15", "u6"), ("c", "2024-01-17", "u8"),
]
EARLIEST = [("a", "2024-01-15", "u4"), ("b", "2024-01-15", "u3"), ("b", "2024-01-16", "u5"), ("c", "2024-01-15", "u6")]


def test_on_arrival_keeps_one_row_per_device_and_day(spark, feed):
    for batch in BATCHES:
        feed.add(startups(*batch))
    rows = to_table(spark, daily_active.on_arrival(as_startup(raw_stream(spark, feed.folder))), "arrival")()
    assert [w[:2] for w in winners(rows)] == [w[:2] for w in FIRST_BATCH]


def test_at_day_end_takes_the_earliest_of_closed_days(spark, feed):
    for batch in BATCHES:
        feed.add(startups(*batch))
    stream = daily_active.at_day_end(as_startup(raw_stream(spark, feed.folder)), "1 hour", ["tie"])
    feed.add(startups(("z", 9, T0 + 2 * DAY + 2 * HOUR)))
    assert winners(to_table(spark, stream, "day-end")()) == EARLIEST


def test_first_batch_with_python_state(spark, feed):
    for batch in BATCHES:
        feed.add(startups(*batch))
    stream = daily_active.first_batch(as_startup(raw_stream(spark, feed.folder)), ["tie"])
    assert winners(to_table(spark, stream, "python-state")()) == FIRST_BATCH


def test_first_batch_with_keyed_table(spark, feed):
    folder = run_folder(spark, "first-batch")
    table = daily_active.daily_active_table(spark, f"{folder}/table")
    sink = daily_active.first_batch_sink(table, "startup", ["tie"])
    for batch in BATCHES:  # one run per file: every run restarts from the checkpoint
        feed.add(startups(*batch))
        stream = as_startup(raw_stream(spark, feed.folder))
        drain(stream.writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    assert winners(table.read()) == FIRST_BATCH
    assert [r[0] for r in A.totals(table.read()).orderBy("logdate").select("total").collect()] == [3, 1, 1]


def event_files(feed, pieces):
    events = pd.read_parquet(f"{FOLDER}/events.parquet").sort_values("ts")
    step = -(-len(events) // pieces)
    for i in range(pieces):
        feed.add(events.iloc[i * step:(i + 1) * step].sample(frac=1, random_state=i))
    return events


def event_stream(spark, feed):
    return spark.readStream.schema(LAYOUT["events"]).option("maxFilesPerTrigger", 1).parquet(feed.folder)


def key_rows(df, columns):
    return sorted(str(tuple(r[c] for c in columns)) for r in df.collect())


def test_daily_active_stream_equals_batch_with_a_restart_between(spark, feed):
    events = pd.read_parquet(f"{FOLDER}/events.parquet").sort_values("ts")
    startup = adapters.startup_log(event_stream(spark, feed))
    run = to_table(spark, daily_active.at_day_end(startup, "1 hour", ["event_id"]), "restart")
    feed.add(events.iloc[:400].sample(frac=1, random_state=1))
    assert 0 < run().count() < 200
    feed.add(events.iloc[400:700]).add(events.iloc[700:])
    got = run()
    batch = A.first_rows(adapters.startup_log(spark.read.schema(LAYOUT["events"]).parquet(feed.folder)), ["event_id"])
    closed = batch.filter(F.col("logdate") < "2024-01-30")
    assert key_rows(got, DAILY_ACTIVE_COLUMNS) == key_rows(closed, DAILY_ACTIVE_COLUMNS)


def stored_alerts(spark, feed, bucket):
    folder = run_folder(spark, "alerts")
    table = alerts.alert_table(spark, f"{folder}/table")
    stream = alerts.live_windows(adapters.event_log(event_stream(spark, feed)), "1 hour", "6 hours", "1 hour")
    stored = lambda: adapters.event_log(spark.read.schema(LAYOUT["events"]).parquet(feed.folder))
    sink = alerts.describing_sink(table, stored, "alerts", "6 hours", "1 hour", bucket)
    drain(stream.writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    return table.read(), stored()


def test_alert_stream_equals_batch(spark, feed):
    events = event_files(feed, 4)
    got, stored = stored_alerts(spark, feed, "1 minute")
    batch = AL.coupon_alerts(stored, window="6 hours", slide="1 hour")
    mark = int(events["ts"].max().value // 1_000_000) - HOUR
    closed = batch.filter(F.col("ts") <= mark)
    assert key_rows(got, ALERT_COLUMNS) == key_rows(closed, ALERT_COLUMNS)
    assert got.count() > 30


def test_stored_alerts_are_throttled(spark, feed):
    event_files(feed, 3)
    stored = stored_alerts(spark, feed, "3 hours")[0].collect()
    assert len({r["alert_id"] for r in stored}) == len(stored) > 15


ORDER = "id string, user_id string, ts bigint"
DETAIL = "id string, order_id string, order_price string, ts bigint"


def side(spark, feed, schema):
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed.folder)
    return df.withColumn("ingest_time", time_of("ts"))


def live_sides(spark, orders, details):
    o = side(spark, orders, ORDER).select(
        "id", "user_id", F.lit("1001").alias("order_status"),
        F.lit("2024-01-15 08:00:00").alias("create_time"), "ingest_time",
    )
    d = side(spark, details, DETAIL).select(
        "id", "order_id", F.lit("7").alias("sku_id"), F.lit("ring").alias("sku_name"), "order_price", "ingest_time",
    )
    return o, d


def feed_sales(tmp_path):
    """Order first, detail first, same batch, and beyond the tolerance."""
    orders, details = Feed(tmp_path / "orders"), Feed(tmp_path / "details")
    s = lambda n: T0 + n * 1000
    order = lambda *rows: orders.add(pd.DataFrame(rows, columns=["id", "user_id", "ts"]))
    detail = lambda *rows: details.add(
        pd.DataFrame(rows, columns=["id", "order_id", "order_price", "ts"]))
    order(("o1", "u1", s(0)), ("o3", "u1", s(0)))
    detail(("d1", "o1", "1", s(0)), ("d2", "o2", "2", s(10)), ("lost", "none", "1", s(5)))
    order(("o2", "u2", s(60)), ("o1", "u1", s(60)))
    detail(("d3", "o1", "3", s(70)), ("d4", "o2", "x", s(70)))
    order(("end", "u", s(900)))
    detail(("end", "-", "1", s(900)))
    order(("end2", "u", s(901)))
    detail(("end2", "-", "1", s(901)))
    return orders, details


def test_live_join_and_enrichment(spark, tmp_path):
    o, d = live_sides(spark, *feed_sales(tmp_path))
    folder = run_folder(spark, "sales")
    table = sales.sale_table(spark, f"{folder}/table")
    people = spark.createDataFrame([("u1", "n", "3", "1990-06-05", "F")], USER_INFO)
    sink = sales.enriching_sink(table, lambda: people, "2024-06-01", "sales")
    drain(sales.live_sale_details(o, d).writeStream.foreachBatch(sink), f"{folder}/checkpoint")
    rows = {r["order_detail_id"]: r for r in table.read().collect()}
    assert sorted(rows) == ["d1", "d2", "d3", "d4"]
    assert (rows["d1"]["user_age"], rows["d1"]["user_gender"], rows["d1"]["sku_price"]) == (34, "F", 1.0)
    assert (rows["d4"]["user_age"], rows["d4"]["user_gender"], rows["d4"]["sku_price"]) == (0, None, None)


def test_live_unmatched_equals_batch_for_expired_rows(spark, tmp_path):
    orders, details = feed_sales(tmp_path)
    o, d = live_sides(spark, orders, details)
    got = to_table(spark, sales.live_unmatched(o, d), "unmatched")()
    lost = sorted((r["side"], r["order_id"], r["order_detail_id"]) for r in got.collect())
    assert lost == [("detail", "none", "lost"), ("order", "o3", None)]


def test_user_snapshot_keeps_the_last_record(spark, feed):
    folder = run_folder(spark, "users")
    table = users.user_table(spark, f"{folder}/table")
    layout = f"{USER_INFO}, seq bigint"
    columns = ["id", "login_name", "user_level", "birthday", "gender", "seq"]
    feed.add(pd.DataFrame([("1", "a", "1", "1990-01-01", "M", 1), ("1", "b", "2", "1990-01-01", "M", 2)], columns=columns))
    feed.add(pd.DataFrame([("1", "c", "3", "1990-01-01", "M", 3), ("2", "d", "1", "1991-01-01", "F", 4)], columns=columns))
    stream = spark.readStream.schema(layout).option("maxFilesPerTrigger", 1).parquet(feed.folder)
    drain(stream.writeStream.foreachBatch(table.upsert_batches("users", ["seq"])), f"{folder}/checkpoint")
    assert sorted((r["id"], r["login_name"]) for r in table.read().collect()) == [("1", "c"), ("2", "d")]


def test_routing_stream_drops_broken_records(spark, tmp_path):
    topic = Feed(tmp_path / "topic")
    topic.add(pd.DataFrame({
        "value": ['{"id":"1","user_level":"2"}', "{broken"],
        "ingest_time": pd.to_datetime(["2024-01-15", "2024-01-15"]),
    }))
    stream = spark.readStream.schema("value string, ingest_time timestamp").parquet(topic.folder)
    rows = to_table(spark, changes.records_of(stream, USER_INFO)[0], "records")().collect()
    assert [(r["id"], r["user_level"], r["gender"]) for r in rows] == [("1", "2", None)]


def test_stage_counts_ride_along(spark, feed):
    for batch in BATCHES:
        feed.add(startups(*batch))
    raw = counted(as_startup(raw_stream(spark, feed.folder)), "raw")
    kept = counted(daily_active.on_arrival(raw), "kept")
    query = drain(kept.writeStream.format("noop"), run_folder(spark, "counts"))
    assert sum(observed_counts(query, "raw")) == 8
    assert sum(observed_counts(query, "kept")) == 5


def test_console_preview(spark, feed):
    feed.add(startups(*BATCHES[0]))
    query = drain(console_writer(raw_stream(spark, feed.folder), rows=2), run_folder(spark, "console"))
    assert query.exception() is None


def test_interval_trigger_starts_and_stops(spark, feed):
    feed.add(startups(*BATCHES[0]))
    name = f"live{uuid.uuid4().hex[:6]}"
    writer = raw_stream(spark, feed.folder).writeStream.format("memory").queryName(name)
    query = start(writer, run_folder(spark, "live"))
    try:
        query.processAllAvailable()
        assert spark.table(name).count() == 3
    finally:
        query.stop()


def test_batch_join_of_the_live_rows(spark, tmp_path):
    """The streamed pairs are those of the batch operator on the same rows."""
    orders, details = feed_sales(tmp_path)
    o = spark.read.schema(ORDER).parquet(orders.folder).withColumn("ingest_time", time_of("ts"))
    d = spark.read.schema(DETAIL).parquet(details.folder).withColumn("ingest_time", time_of("ts"))
    o = o.withColumn("order_status", F.lit("s")).withColumn("create_time", F.lit("2024-01-15 08:00:00"))
    d = d.withColumn("sku_id", F.lit("7")).withColumn("sku_name", F.lit("ring"))
    table = KeyedTable(spark, run_folder(spark, "b"), "order_detail_id string", ["order_detail_id"])
    table.write(SD.sale_details(o, d).select("order_detail_id"), "b", 0)
    assert sorted(r[0] for r in table.read().collect()) == ["d1", "d2", "d3", "d4"]


def test_salted_streams_give_the_same_rows(spark, tmp_path):
    feed = Feed(tmp_path / "in")
    for batch in BATCHES:
        feed.add(startups(*batch))
    stream = daily_active.on_arrival(as_startup(raw_stream(spark, feed.folder)), salts=3)
    assert [w[:2] for w in winners(to_table(spark, stream, "salted")())] == [w[:2] for w in FIRST_BATCH]
    o, d = live_sides(spark, *feed_sales(tmp_path))
    pairs = to_table(spark, sales.live_sale_details(o, d, salts=3), "salted-join")()
    assert sorted({r["order_detail_id"] for r in pairs.collect()}) == ["d1", "d2", "d3", "d4"]


def test_a_stray_topic_file_is_not_read(spark, tmp_path):
    root = str(tmp_path / "topics")
    source = str(tmp_path / "source")
    spark.createDataFrame([("order_info", "{}")] * 2, "topic string, value string").write.parquet(source)
    messages = spark.readStream.schema("topic string, value string").parquet(source)
    drain(topics_writer(messages, root), str(tmp_path / "checkpoint"))
    stray = spark.createDataFrame([("{}", None)] * 2, "value string, ingest_time timestamp")
    stray.write.mode("append").parquet(f"{root}/topic=order_info")
    assert read_topic(spark, root, "order_info").count() == 2


def test_a_late_order_within_the_tolerance_is_joined(spark, tmp_path):
    orders, details = Feed(tmp_path / "o"), Feed(tmp_path / "d")
    for stamp in (300_000, 600_000):
        orders.add(pd.DataFrame({"id": [f"o{stamp}"], "user_id": ["u"], "ts": [stamp]}))
        details.add(pd.DataFrame({"id": [f"x{stamp}"], "order_id": ["none"], "order_price": ["1"], "ts": [stamp]}))
    orders.add(pd.DataFrame({"id": ["late"], "user_id": ["u"], "ts": [550_000]}))
    details.add(pd.DataFrame({"id": ["d"], "order_id": ["late"], "order_price": ["1"], "ts": [610_000]}))
    o, d = live_sides(spark, orders, details)
    got = to_table(spark, sales.live_sale_details(o, d), "late")()
    assert [r["order_detail_id"] for r in got.collect()] == ["d"]
