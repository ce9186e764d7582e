"""One stream to several outputs, outcomes of bulk writes, and the seen set read from state."""

import time

import pytest

from feeds import Feed
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.sinks.outcomes import write_items
from pulsecart.streaming import daily_active
from pulsecart.streaming.fan_out import fan_out
from pulsecart.streaming.runtime import drain, start
from pulsecart.workspace import run_folder
from test_streams import T0, DAY, HOUR, as_startup, raw_stream, startups


def outcomes(df):
    return sorted((r["outcome"], r["reason"] or "", r["items"]) for r in df.collect())


# -- fan-out -------------------------------------------------------------------------------------


def test_crash_between_outputs_repeats_only_the_missing_ones(spark, tmp_path):
    feed, folder = Feed(tmp_path / "in"), run_folder(spark, "fan")
    ran, fail = [], [True]
    computed = spark.sparkContext.accumulator(0)

    def derive(batch):
        def counted(frames):
            for frame in frames:
                computed.add(len(frame))
                yield frame

        return {"rows": batch.select("mid").mapInPandas(counted, "mid string")}

    def output(name, broken=False):
        def write(frames, batch_id):
            ran.append((name, batch_id, frames["rows"].count()))
            if broken and fail[0]:
                raise RuntimeError("lost")

        return write

    outputs = {"a": output("a"), "b": output("b", broken=True), "c": output("c")}

    def run():
        stream = raw_stream(spark, feed.folder)
        drain(stream.writeStream.foreachBatch(fan_out(spark, folder, outputs, derive)), f"{folder}/checkpoint")

    feed.add(startups(("x", 1, T0), ("y", 2, T0)))
    with pytest.raises(Exception, match="lost"):
        run()
    assert ran == [("a", 0, 2), ("b", 0, 2)] and computed.value == 2  # the frame is kept for both
    fail[0] = False
    run()
    assert ran[2:] == [("b", 0, 2), ("c", 0, 2)]
    feed.add(startups(("z", 3, T0)))
    run()
    assert ran[4:] == [("a", 1, 1), ("b", 1, 1), ("c", 1, 1)]


def test_finished_batch_is_left_alone(spark):
    ran, folder = [], run_folder(spark, "fan")
    sink = fan_out(spark, folder, {"a": lambda frames, n: ran.append(frames["rows"].count())})
    for _ in range(2):
        sink(spark.range(3), 5)
    assert ran == [3]


# -- outcome of every item -----------------------------------------------------------------------

RAW = "id string, amount string, kind string, seq string"
ITEMS = [
    ("1", "1.5", "k", "1"), ("1", "2.5", "k", "2"), ("2", "x", "k", "3"), ("3", None, "k", "4"), ("4", "1", None, "x"),
    (None, "7", "k", "6"), (None, "7", "k", "6"), ("y" * 513, "1", "k", "7"), ("é" * 256, "1", "k", "8"),
]


@pytest.fixture
def table(spark):
    return KeyedTable(spark, run_folder(spark, "items"), "id string, amount double, kind string, seq bigint", ["id"])


def write(table, rows, batch):
    return write_items(table, table.spark.createDataFrame(rows, RAW), "w", batch, ["seq"], ["kind"])


def test_outcomes_and_refused_rows(spark, table):
    got = outcomes(write(table, ITEMS, 0))
    assert got == [
        ("created", "", 5), ("rejected", "amount malformed", 1), ("rejected", "id too long", 1),
        ("rejected", "kind missing", 1), ("replaced", "", 1),
    ]
    stored = {r["id"]: r["amount"] for r in table.read().collect()}
    assert len(stored) == 5 and stored["1"] == 2.5 and stored["3"] is None
    refused = spark.read.parquet(f"{table.path}/refused/w/000000000000")
    assert sorted((r["id"][:1], r["amount"], r["_reason"]) for r in refused.collect()) == [
        ("2", "x", "amount malformed"), ("4", "1", "kind missing"), ("y", "1", "id too long"),
    ]


def test_known_keys_are_updates_and_a_repeat_stores_nothing_new(table):
    write(table, ITEMS, 0)
    batch = [("1", "9", "k", "9"), ("5", "1", "k", "1")]
    assert outcomes(write(table, batch, 1)) == [("created", "", 1), ("updated", "", 1)]
    assert outcomes(write(table, batch, 1)) == [("updated", "", 2)]
    assert table.read().count() == 6


def test_outcomes_of_an_empty_batch(table):
    assert outcomes(write(table, [], 0)) == []
    assert outcomes(write(table, [("2", "x", "k", "3")], 1)) == [("rejected", "amount malformed", 1)]


def test_outcomes_by_day(spark):
    days = KeyedTable(spark, run_folder(spark, "items"), "id string, dt string, n int", ["id"], day_column="dt")
    rows = lambda *data: spark.createDataFrame(list(data), "id string, dt string, n string")
    write_items(days, rows(("a", "2024-01-01", "1")), "w", 0)
    got = write_items(days, rows(("a", "2024-01-01", "2"), ("a", "2024-01-02", "3")), "w", 1)
    assert outcomes(got) == [("created", "", 1), ("updated", "", 1)]


# -- seen set ------------------------------------------------------------------------------------


def run_seen(spark, feed, folder, keep, clock):
    rows = daily_active.first_batch(as_startup(raw_stream(spark, feed.folder)), ["tie"], keep, clock)
    drain(rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows"), f"{folder}/checkpoint")
    return daily_active.seen_set(spark, f"{folder}/checkpoint")


def keys(df):
    return sorted((r["mid"], r["logdate"]) for r in df.collect())


def test_seen_set_by_event_time(spark, tmp_path):
    feed, folder = Feed(tmp_path / "in"), run_folder(spark, "seen")
    feed.add(startups(("a", 1, T0), ("a", 2, T0 + HOUR), ("b", 3, T0 + 2 * HOUR)))
    seen = run_seen(spark, feed, folder, "24 hours", "event")
    assert sorted((r["mid"], r["until"]) for r in seen.collect()) == [("a", T0 + DAY), ("b", T0 + DAY + 2 * HOUR)]
    assert keys(daily_active.seen_set(spark, f"{folder}/checkpoint", T0 + DAY)) == [("b", "2024-01-15")]
    feed.add(startups(("c", 4, T0 + 2 * DAY + HOUR)))  # the watermark passes the end of a, not of b
    assert keys(run_seen(spark, feed, folder, "24 hours", "event")) == [("b", "2024-01-15"), ("c", "2024-01-17")]


def test_seen_set_that_expires_by_the_wall_clock(spark, tmp_path):
    feed, folder = Feed(tmp_path / "in"), run_folder(spark, "seen")
    rows = daily_active.first_batch(as_startup(raw_stream(spark, feed.folder)), ["tie"], "4 seconds", "processing")
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
    query = start(writer, f"{folder}/checkpoint", "1 second")

    def passed(*uids):
        until = time.time() + 60
        while time.time() < until:
            found = sorted(r["uid"] for r in spark.read.schema(rows.schema).parquet(f"{folder}/rows").collect())
            if found == sorted(uids):
                return True
            time.sleep(0.3)
        return False

    try:
        feed.add(startups(("a", 1, T0)))
        assert passed("u1")
        time.sleep(6)
        feed.add(startups(("a", 2, T0 + HOUR), ("b", 3, T0)))
        assert passed("u1", "u2", "u3")  # a was forgotten, so it is passed again
    finally:
        query.stop()
    assert {k[0] for k in keys(daily_active.seen_set(spark, f"{folder}/checkpoint"))} <= {"a", "b"}


def test_unknown_clock(spark, tmp_path):
    with pytest.raises(ValueError):
        daily_active.first_batch(as_startup(raw_stream(spark, str(tmp_path))), clock="sundial")
