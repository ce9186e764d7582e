"""Snapshot in buckets, inverted index, and order value with retractions."""

import random

import pytest
from pyspark.sql import functions as F

from pulsecart.functions import has_any_token
from pulsecart.sources.postings import Postings
from pulsecart.sources.snapshot import BucketedSnapshot
from pulsecart.streaming import gmv
from pulsecart.streaming.runtime import drain
from pulsecart.workspace import run_folder

USERS = "id string, name string, seq int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# -- snapshot ------------------------------------------------------------------------------------


@pytest.fixture
def snapshot(spark):
    users = BucketedSnapshot(spark, run_folder(spark, "users"), USERS, buckets=16)
    users.write(spark.range(500).select(F.col("id").cast("string").alias("id"), F.lit("old").alias("name"), F.lit(1).alias("seq")), "w", 0)
    return users


def test_a_batch_reads_only_the_buckets_of_its_keys(spark, snapshot):
    batch = spark.createDataFrame([("7", 1), ("7", 2), ("300", 3), (None, 4)], "user string, n int")
    users = snapshot.of_batch(batch, "user")
    wanted = {r[0] for r in batch.where("user IS NOT NULL").select(snapshot.bucket_of(F.col("user"))).collect()}
    assert {f.split("_part=")[1].split("/")[0] for f in users.inputFiles()} == wanted and len(wanted) <= 2
    assert sorted(r["n"] for r in batch.join(users, batch["user"] == users["id"]).collect()) == [1, 2, 3]
    assert users.count() < 500


def test_one_key_reads_one_bucket_with_the_key_pushed_down(snapshot):
    found = snapshot.of_key("42")
    assert "EqualTo(id,42)" in plan(found) and len({f.split("_part=")[1][:5] for f in found.inputFiles()}) == 1
    assert [tuple(r) for r in found.collect()] == [("42", "old", 1)]
    assert snapshot.of_key("none").count() == 0


def test_later_writes_win_in_a_snapshot(spark, snapshot):
    rows = spark.createDataFrame([("7", "b", 3), ("7", "a", 2), (None, "x", 1), ("new", "n", 1)], USERS)
    assert snapshot.write(rows, "w", 1, ["seq"]) and not snapshot.write(rows, "w", 1, ["seq"])
    assert [r["name"] for r in snapshot.of_key("7").collect()] == ["b"]
    every = snapshot.of_batch(spark.range(500).select(F.col("id").cast("string").alias("k")), "k")
    assert every.count() == 501


def test_a_lookup_of_nothing_is_empty(spark, snapshot):
    none = spark.createDataFrame([(None,)], "k string")
    assert snapshot.of_batch(none, "k").count() == 0
    fresh = BucketedSnapshot(spark, run_folder(spark, "users"), USERS)
    assert fresh.of_key("1").columns == ["id", "name", "seq"] and fresh.of_key("1").count() == 0


# -- postings ------------------------------------------------------------------------------------

WORDS = ["ring", "Bolt", "steel-blue", "天地", "x_1", "", "..."]
DOCS = "_id string, name string"


def test_postings_equal_the_scan_through_upserts(spark):
    r = random.Random(6)
    postings, now = Postings(spark, run_folder(spark, "p"), buckets=4), {}
    for batch in range(3):
        changed = {str(i): r.choice([None, " ".join(r.choices(WORDS, k=r.randrange(5)))]) for i in r.sample(range(40), 20)}
        now.update(changed)
        rows = spark.createDataFrame(sorted(changed.items()), DOCS)
        for _ in range(2):  # sent twice
            postings.upsert(rows, "name", "w", batch)
        docs = spark.createDataFrame(sorted(now.items()), DOCS)
        for wanted in ("RING", "ring bolt", "地", "blue x_1", "...", "absent"):
            scan = {d["_id"] for d in docs.where(has_any_token("name", wanted)).collect()}
            assert {d["_id"] for d in postings.matching(docs, wanted).collect()} == scan, wanted


def test_a_search_reads_only_the_buckets_of_its_tokens(spark):
    postings = Postings(spark, run_folder(spark, "p"), buckets=8)
    docs = spark.range(300).select(F.col("id").cast("string").alias("_id"), F.concat(F.lit("w"), F.col("id") % 50).alias("name"))
    postings.upsert(docs, "name", "w", 0)
    found = postings.any_of("w7")
    assert len({f.split("_part=")[1][:5] for f in found.inputFiles()}) == 1
    assert "PushedFilters: [" in plan(found) and "EqualTo(token,w7)" in plan(found)
    assert sorted(int(r["id"]) for r in found.collect()) == [7, 57, 107, 157, 207, 257]
    assert postings.any_of("").count() == 0


# -- order value ---------------------------------------------------------------------------------


def order(i, time, amount):
    return None if time is None else (str(i), time, amount)


CHANGES = f"before {gmv.ORDER}, after {gmv.ORDER}"


@pytest.mark.parametrize("orders", [[0, 1, 2], [2, 0, 1]])
def test_retractions_leave_the_final_orders(spark, orders):
    day, later = "2024-01-15 10:00:00", "2024-01-16 11:30:00"
    batches = [
        [(None, order(1, day, 10.10)), (None, order(2, day, 0.2)), (None, order(3, later, None))],
        [(order(1, day, 10.10), order(1, later, 7.07)), (order(2, day, 0.2), None)],
        [(None, order(4, day, 5.0)), (order(4, day, 5.0), order(4, day, 6.0)), (order(4, day, 6.0), order(4, day, 6.25))],
    ]
    folder = run_folder(spark, "gmv")
    table = gmv.value_table(spark, f"{folder}/table")
    for n in orders:  # also with retractions before what they retract
        spark.createDataFrame(batches[n], CHANGES).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        changes = spark.readStream.schema(CHANGES).parquet(f"{folder}/in")
        writer = gmv.gross_value_so_far(changes).writeStream.outputMode("update").foreachBatch(table.upsert_batches("w"))
        drain(writer, f"{folder}/checkpoint")
    got = sorted(tuple(r) for r in gmv.current_value(table).collect())
    assert got == [("2024-01-15", "10", 6.25, 1), ("2024-01-16", "11", 7.07, 2)]


def test_an_hour_without_orders_is_not_shown(spark):
    row = (order(1, "2024-01-15 10:00:00", 1.0), None)
    changes = spark.createDataFrame([row, row[::-1]], CHANGES)
    assert [tuple(r)[1:] for r in gmv.gross_value_so_far(changes).collect()] == [("10", 0, 0)]
