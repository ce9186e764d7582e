"""Work that must not grow with the number of keys, batches or reads of a batch."""

import re

import pandas as pd

from feeds import Feed
from pulsecart.functions import time_of
from pulsecart.operators import sales as SD
from pulsecart.operators.keyed import with_generated_ids
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.streaming import daily_active
from pulsecart.streaming.runtime import ROWS_AT_ONCE, drain
from pulsecart.workspace import run_folder
from test_streams import DAY, HOUR, T0, as_startup, raw_stream, startups


def first_batch(spark, feed, folder, keep="48 hours", **more):
    rows = daily_active.first_batch(as_startup(raw_stream(spark, feed.folder)), ["tie"], keep, **more)
    drain(rows.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows"), f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


def test_devices_of_a_day_share_groups_of_state(spark, tmp_path):
    feed, folder = Feed(tmp_path / "in"), run_folder(spark, "groups")
    devices = [(f"m{i}", i + 1000 * r, T0 + (r * 37 + i) % 90) for i in range(300) for r in range(3)]
    feed.add(startups(*devices)).add(startups(("m1", 9000, T0), ("new", 9001, T0), (None, 9002, T0)))
    got = first_batch(spark, feed, folder, buckets=8)
    best = pd.DataFrame(devices, columns=["mid", "tie", "ts"]).sort_values(["ts", "tie"]).drop_duplicates("mid")
    expected = {(m, f"u{t}") for m, t in zip(best["mid"], best["tie"])} | {("new", "u9001"), (None, "u9002")}
    assert {(r["mid"], r["uid"]) for r in got.collect()} == expected and got.count() == 302
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/checkpoint")
    assert state.select("key").distinct().count() == 8


def test_part_of_a_group_of_state_runs_out(spark, tmp_path):
    feed, folder = Feed(tmp_path / "in"), run_folder(spark, "part")
    feed.add(startups(("a", 1, T0), ("b", 2, T0 + 2 * HOUR), ("c", 3, T0 + 5 * HOUR)))
    feed.add(startups(("z", 4, T0 + 2 * DAY + HOUR)))  # the watermark passes the end of a
    feed.add(startups(("b", 5, T0 + DAY + 3 * HOUR), ("z", 6, T0 + 2 * DAY + 3 * HOUR)))  # and then that of b
    rows = first_batch(spark, feed, folder, "24 hours", buckets=1)
    assert sorted(r["uid"] for r in rows.collect()) == ["u1", "u2", "u3", "u4", "u5"]
    seen = daily_active.seen_set(spark, f"{folder}/checkpoint")
    assert {(r["mid"], r["logdate"], r["until"]) for r in seen.collect()} == {
        ("c", "2024-01-15", T0 + DAY + 5 * HOUR), ("b", "2024-01-16", T0 + 2 * DAY + 3 * HOUR),
        ("z", "2024-01-17", T0 + 3 * DAY + HOUR),
    }


def test_a_stream_of_pairs_has_no_batches_without_rows(spark, tmp_path):
    folder, feed = run_folder(spark, "pairs"), Feed(tmp_path / "in")
    feed.add(startups(("a", 1, T0))).add(startups(("a", 2, T0 + 9 * DAY)))
    rows = daily_active.earliest_so_far(as_startup(raw_stream(spark, feed.folder)), "1 hour", ["tie"])
    sizes = []
    writer = rows.writeStream.outputMode("update").foreachBatch(lambda batch, _: sizes.append(batch.count()))
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    drain(writer, f"{folder}/checkpoint", ROWS_AT_ONCE)
    assert sizes == [1, 1] and spark.conf.get(key) == before


def test_whole_details_are_read_once_for_the_pairs_and_the_details_alone(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame(
        [("1", "s", "2024-01-01 00:00:00", "u", 0), ("1", "s", "2024-01-01 00:00:00", "u", 50), ("2", "s", "x", "u", 0),
         (None, "s", "x", "u", 0)],
        "id string, order_status string, create_time string, user_id string, at bigint",
    ).withColumn("ingest_time", time_of("at")).drop("at").write.parquet(f"{folder}/o")
    spark.createDataFrame([("a", "1", 10), ("a", "1", 10), ("b", "1", 999_000), ("c", None, 0)], "id string, order_id string, at bigint").withColumn(
        "ingest_time", time_of("at")).drop("at").write.parquet(f"{folder}/d")
    got = SD.pairs_and_alone(spark.read.parquet(f"{folder}/o"), spark.read.parquet(f"{folder}/d"), "30 seconds")
    rows = sorted(((r["o_id"], r["d_id"]) for r in got.collect()), key=str)
    assert rows == sorted([("1", "a")] * 4 + [("2", None), (None, None), (None, "b"), (None, "c")], key=str)
    scans = re.findall(r"FileScan parquet \[([^]]*)\][^\n]*?/d\]", got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().sparkPlan().toString())
    assert sum("id#" in re.sub("order_id#", "", s) for s in scans) == 1 and len(scans) == 2


def test_a_batch_is_read_once_for_a_keyed_table(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(rows):
        for part in rows:
            reads.add(len(part))
            yield part

    layout = "id string, dt string, n int"
    data = [("a", "2024-01-01", 1), ("a", "2024-01-01", 2), (None, "2024-01-01", 3), (None, "2024-01-01", 3), (None, "2024-01-02", 4)]
    table = KeyedTable(spark, run_folder(spark, "once"), layout, ["id"], day_column="dt")
    batch = spark.createDataFrame(data, layout).coalesce(1).mapInPandas(seen, layout)
    assert table.write(batch, "w", 0, ["n"]) and reads.value == len(data)
    got = table.read().collect()
    assert sorted((r["dt"], r["n"]) for r in got) == [("2024-01-01", 2), ("2024-01-01", 3), ("2024-01-01", 3), ("2024-01-02", 4)]
    whole = with_generated_ids(spark.createDataFrame(data, layout), "id", "w", "0")
    assert {r["id"] for r in got} == {r["id"] for r in whole.collect()}


def test_devices_of_a_batch_are_one_entry_of_state(spark, tmp_path):
    feed, folder = Feed(tmp_path / "in"), run_folder(spark, "entries")
    first_batch(spark, feed.add(startups(*[(f"m{i}", i, T0) for i in range(300)])), folder, buckets=8)
    first_batch(spark, feed.add(startups(("m1", 9000, T0), ("new", 9001, T0), (None, 9002, T0))), folder, buckets=8)
    state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/checkpoint")
    assert 9 <= state.count() <= 10
    seen = daily_active.seen_set(spark, f"{folder}/checkpoint")
    assert seen.columns == ["mid", "logdate", "until"]
    assert sorted(str(r["mid"]) for r in seen.collect()) == sorted(["None", "new", *(f"m{i}" for i in range(300))])


def test_a_batch_of_a_stream_with_state_puts_few_files_into_a_day(spark, tmp_path):
    folder, feed = run_folder(spark, "files"), Feed(tmp_path / "in")
    feed.add(startups(*[(f"m{i}", i, T0 + i % 2 * DAY) for i in range(300)]))
    table = daily_active.daily_active_table(spark, f"{folder}/table")
    rows = daily_active.earliest_so_far(as_startup(raw_stream(spark, feed.folder)), "1 hour", ["tie"])
    writer = rows.writeStream.outputMode("update").foreachBatch(table.upsert_batches("w"))
    drain(writer, f"{folder}/checkpoint", {"spark.sql.shuffle.partitions": "8"})
    files = spark.read.parquet(f"{folder}/table/rows").inputFiles()
    assert len(files) == 2 and table.read().count() == 300
