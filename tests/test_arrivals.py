"""The join by arrival, against a replay of the arrivals one by one."""

import random
import time
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from feeds import Feed
from pulsecart.streaming.arrival_batches import arrival_sink, arrivals_of
from pulsecart.streaming.arrivals import arrival_pairs
from pulsecart.streaming.runtime import drain, start
from pulsecart.workspace import run_folder

KEEP = 100
T0 = 1_700_000_000
ORDERS = "id string, order_status string, create_time string, user_id string, at bigint"
DETAILS = "id string, order_id string, sku int, at bigint"


def replay(arrivals, keep=KEEP):
    """Pairs of order status and detail id, with repeats, from (time, kind, order id, name) in order of time."""
    orders, waiting, pairs = {}, {}, []
    for at, kind, order_id, name in sorted(arrivals, key=lambda a: (a[0], a[1])):
        if order_id in orders and at >= orders[order_id][1]:
            del orders[order_id]
        if order_id in waiting and at >= waiting[order_id][1]:
            del waiting[order_id]
        if kind == "a order":
            orders[order_id] = (name, at + keep)
            pairs += [(name, d) for d in waiting.get(order_id, ((), 0))[0]]
        elif order_id in orders:
            pairs.append((orders[order_id][0], name))
        else:
            known = waiting.get(order_id, ([], 0))[0]
            waiting[order_id] = ([*known, name] if name not in known else known, at + keep)
    return sorted(pairs)


class Join:
    def __init__(self, spark, tmp_path, clock="transport"):
        self.spark, self.clock = spark, clock
        self.orders, self.details = Feed(tmp_path / "orders"), Feed(tmp_path / "details")
        self.folder = run_folder(spark, "arrivals")

    def batch(self, arrivals):
        orders = [(o, name, "", "u", T0 + at) for at, kind, o, name in arrivals if kind == "a order"]
        details = [(name, o, 7, T0 + at) for at, kind, o, name in arrivals if kind == "detail"]
        self.orders.add(pd.DataFrame(orders, columns=["id", "order_status", "create_time", "user_id", "at"]))
        self.details.add(pd.DataFrame(details, columns=["id", "order_id", "sku", "at"]).astype({"sku": "int32"}))

    def sides(self):
        def rows(feed, schema):
            read = self.spark.readStream.schema(schema).parquet(feed.folder)
            return read.withColumn("ingest_time", F.timestamp_seconds("at")).drop("at")

        return rows(self.orders, ORDERS), rows(self.details, DETAILS)

    def pairs(self):
        return arrival_pairs(*self.sides(), f"{KEEP} seconds", self.clock)

    def writer(self):
        return self.pairs().writeStream.format("parquet").outputMode("append").option("path", f"{self.folder}/rows")

    def found(self):
        rows = self.spark.read.schema(self.pairs().schema).parquet(f"{self.folder}/rows").collect()
        return sorted((r["o_order_status"], r["d_id"]) for r in rows)

    def passed(self, query):
        """Whether the details that were put are read."""
        return any(p["numInputRows"] for p in query.recentProgress)

    def run(self):
        drain(self.writer(), f"{self.folder}/checkpoint")
        return self.found()


class BatchJoin(Join):
    """The same with window functions in each batch."""

    def write(self, pairs, batch_id):
        pairs.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")

    def sink(self):
        return arrival_sink(self.folder, self.write, f"{KEEP} seconds", self.clock)

    def writer(self):
        return arrivals_of(*self.sides()).writeStream.foreachBatch(self.sink())


GOLDEN = [
    # A waits 180 s, as its set was refreshed at 90 s; the interval join would miss the pair.
    (0, "detail", "1", "A"), (90, "detail", "1", "B"), (180, "a order", "1", "o1"),
    # C has been forgotten when D comes; D alone is paired.
    (0, "detail", "2", "C"), (150, "detail", "2", "D"), (200, "a order", "2", "o2"),
    # The order is remembered up to 100 s, and a second delivery starts anew and meets its waiting details.
    (0, "a order", "3", "o3"), (99, "detail", "3", "E"), (100, "detail", "3", "F"), (120, "a order", "3", "o3b"),
    (219, "detail", "3", "G"), (220, "detail", "3", "H"),
    # A detail delivered twice waits once.
    (5, "detail", "4", "I"), (6, "detail", "4", "I"), (7, "a order", "4", "o4"),
]


@pytest.mark.parametrize("form", [Join, BatchJoin])
@pytest.mark.parametrize("cuts", [[], [95, 160]])
def test_golden_arrivals(spark, tmp_path, cuts, form):
    join = form(spark, tmp_path)
    for low, high in zip([-1, *cuts], [*cuts, 1000]):
        join.batch([a for a in GOLDEN if low < a[0] <= high])
        found = join.run()
    want = [("o1", "A"), ("o1", "B"), ("o2", "D"), ("o3", "E"), ("o3b", "F"), ("o3b", "G"), ("o4", "I")]
    assert found == want == replay(GOLDEN)


@pytest.mark.parametrize("form", [Join, BatchJoin])
def test_random_arrivals_equal_the_replay(spark, tmp_path, form):
    draw = random.Random(4)
    arrivals = []
    for n in range(60):
        for i in range(draw.randrange(1, 9)):
            kind = draw.choice(["a order", "detail", "detail"])
            arrivals.append((draw.randrange(600), kind, f"k{n}", f"{kind[0]}{n}-{i}"))
    join = form(spark, tmp_path)
    for low in (0, 200, 400):
        join.batch([a for a in arrivals if low <= a[0] < low + 200])
        found = join.run()
    assert found == replay(arrivals) and len(found) > 60


@pytest.mark.parametrize("form", [Join, BatchJoin])
def test_wall_clock_and_rows_without_an_order(spark, tmp_path, form):
    join = form(spark, tmp_path, clock="processing")
    join.batch([(0, "detail", "1", "A"), (500, "detail", None, "N"), (900, "detail", "2", "B")])
    # A stream with timers of the wall clock never runs out of batches, so it is stopped.
    query = start(join.writer(), f"{join.folder}/checkpoint", "1 second")
    try:
        until = time.time() + 60
        while time.time() < until and not (query.lastProgress and query.lastProgress["batchId"] >= 0 and join.passed(query)):
            time.sleep(0.2)
        join.batch([(0, "a order", "1", "o1"), (0, "a order", None, "oN"), (0, "a order", "9", "o9")])
        while time.time() < until and not join.found():
            time.sleep(0.5)
    finally:
        query.stop()
    # Arrival is the time of the batch, so A still waits whatever its transport time.
    assert join.found() == [("o1", "A")]


def test_unknown_clock(spark, tmp_path):
    with pytest.raises(ValueError):
        Join(spark, tmp_path, clock="sundial").run()


def test_a_repeated_batch_gives_its_pairs_once(spark, tmp_path):
    join = BatchJoin(spark, tmp_path, clock="transport")
    rows = spark.createDataFrame(
        [("1", 1, 0, None, ("A", 7)), ("2", 1, 0, None, ("B", 7)), ("1", 1, 60_000_000, None, ("A", 7))],
        "order_id string, side int, arrived bigint, o struct<order_status:string,create_time:string,user_id:string>, d struct<id:string,sku:int>",
    )
    orders = spark.createDataFrame(
        [("1", 0, 130_000_000, ("o1", "", "u"), None), ("2", 0, 130_000_000, ("o2", "", "u"), None)], rows.schema
    )
    sink = join.sink()
    for batch, part in enumerate((rows, orders, rows.limit(0), rows.limit(0))):
        sink(part, batch)
        sink(part, batch)
    # A was refreshed at 60 s by its second delivery, B has been forgotten; only the last two states are kept.
    assert join.found() == [("o1", "A")]
    assert sorted(p.name for p in Path(f"{join.folder}/state").iterdir()) == ["2", "3"]
