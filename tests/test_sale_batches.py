"""The interval join batch by batch, against all pairs of all rows."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from feeds import Feed
from pulsecart.operators import sales as SD
from pulsecart.streaming import sales
from pulsecart.streaming.runtime import drain
from pulsecart.streaming.sale_batches import both_sides, holding_sink
from pulsecart.workspace import run_folder, shared_folder

T0 = 1_700_000_000
ORDERS = "id string, order_status string, create_time string, user_id string, at bigint"
DETAILS = "id string, order_id string, sku int, at bigint"


class Join:
    """Tolerance 100 seconds; ``batch`` takes (order id, status, second) and (detail id, order id, second)."""

    def __init__(self, spark, tmp_path, delay=None):
        self.spark, self.folder = spark, run_folder(spark, "held")
        self.feeds = Feed(tmp_path / "orders"), Feed(tmp_path / "details")
        records = lambda rows: rows.withColumnRenamed("came", "ingest_time")
        self.sink = holding_sink(self.folder, self.pair, records, records, "100 seconds", delay)
        self.delay, self.ran = delay, []

    def pair(self, orders, details, batch_id):
        self.ran.append(batch_id)
        pairs = sales.live_pairs(orders, details, "100 seconds", self.delay)
        pairs.select("o_order_status", "d_id", "d_sku").write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")

    def batch(self, orders=(), details=()):
        orders = [(o, status, "", "u", None if at is None else T0 + at) for o, status, at in orders]
        details = [(d, o, 7, None if at is None else T0 + at) for d, o, at in details]
        for feed, rows, names in zip(self.feeds, (orders, details), (ORDERS, DETAILS)):
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in names.split(", ")])
            feed.add(frame.astype({"at": "Int64"} | ({"sku": "int32"} if "sku" in frame else {})))
        o, d = (
            self.spark.readStream.schema(names).parquet(feed.folder).withColumn("came", F.timestamp_seconds("at")).drop("at")
            for feed, names in zip(self.feeds, (ORDERS, DETAILS))
        )
        drain(both_sides(o, d, "came", "came").writeStream.foreachBatch(self.sink), f"{self.folder}/checkpoint")
        return self

    def pairs(self):
        rows = self.spark.read.parquet(f"{self.folder}/rows").collect()
        assert all(r["d_sku"] == 7 for r in rows)
        return sorted((r["o_order_status"], r["d_id"]) for r in rows)

    def held(self, batch_id):
        rows = self.spark.read.parquet(f"{self.folder}/held/{batch_id}").collect()
        return sorted(r["o"]["order_status"] if r["side"] == 0 else r["d"]["id"] for r in rows)


def test_batches_give_the_pairs_of_all_rows(spark, tmp_path):
    """Times that go up and down by less than the delay, orders delivered anew, rows that come twice or without key or time."""
    rnd = random.Random(5)
    join, all_orders, all_details = Join(spark, tmp_path, "300 seconds"), [], []
    for n in range(4):
        at = lambda: n * 200 + rnd.randrange(250)
        orders = [(f"o{rnd.randrange(8)}", f"s{n}-{i}", at()) for i in range(12)] + [(None, f"none{n}", at()), ("o1", f"never{n}", None)]
        details = [(f"d{n}-{i}", f"o{rnd.randrange(8)}", at()) for i in range(20)] + [(f"lost{n}", None, at()), (f"never{n}", "o1", None)]
        join.batch([*orders, orders[0]], [*details, details[0]])
        all_orders += [*orders, orders[0]]
        all_details += [*details, details[0]]
    expected = [
        (status, d) for o, status, t in all_orders for d, of, u in all_details
        if None not in (o, of, t, u) and o == of and abs(t - u) <= 100
    ]
    assert join.pairs() == sorted(expected) and len(expected) > 50


def test_rows_are_held_for_the_delay_and_the_tolerance(spark, tmp_path):
    join = Join(spark, tmp_path, "150 seconds")
    join.batch([("a", "old", 0), ("a", "edge", 750), ("b", "new", 1000)], [("x", "a", 100), ("y", "c", 1200)])
    assert join.pairs() == [("old", "x")]
    assert join.held(0) == ["edge", "new", "y"]  # the slower side is at 1000: 250 seconds back are held
    join.batch([("c", "late", 1150)], [("z", "a", 850)])
    assert join.pairs() == [("edge", "z"), ("late", "y"), ("old", "x")]
    assert join.held(1) == ["late", "new", "y"]


def test_a_side_without_rows_holds_the_other(spark, tmp_path):
    join = Join(spark, tmp_path)
    join.batch(details=[("x", "a", 0), ("y", "b", 5000)]).batch([("a", "s", 50)])
    assert join.pairs() == [("s", "x")] and join.held(1) == ["s", "x", "y"]


def test_a_repeated_batch_gives_the_same(spark, tmp_path):
    join = Join(spark, tmp_path)
    join.batch([("a", "s", 0)], [("x", "b", 0)]).batch([("b", "t", 10)], [("y", "a", 10), ("z", "b", 20)])
    expected, held = join.pairs(), join.held(1)
    assert expected == [("s", "y"), ("t", "x"), ("t", "z")]
    for name in ("commits/1", "commits/.1.crc"):
        if os.path.exists(path := f"{join.folder}/checkpoint/{name}"):
            os.remove(path)
    join.batch([("c", "u", 30)])
    assert join.pairs() == expected and join.held(1) == held
    assert join.ran == [0, 1, 1, 2] and not os.path.exists(f"{join.folder}/held/0")


def test_held_rows_are_refused_in_an_outer_join(spark):
    o = spark.createDataFrame([], f"{ORDERS}, ingest_time timestamp, held boolean")
    d = spark.createDataFrame([], f"{DETAILS}, ingest_time timestamp, held boolean")
    with pytest.raises(ValueError, match="held"):
        SD.pair_within(o, d, how="full_outer")


def test_the_late_query_does_not_put_all_rows_into_state(spark, tmp_path):
    day = lambda n: datetime(1995, 1, 1) + timedelta(days=n)
    days = range(0, 2400, 4)
    orders = pd.DataFrame({
        "o_orderkey": days, "o_custkey": [1] * len(days), "o_orderstatus": ["F"] * len(days),
        "o_totalprice": [1.0] * len(days), "o_orderdate": [day(n) for n in days], "o_orderpriority": ["1"] * len(days),
    })
    late = [(n, line, n + 1 + 23 * line) for n in days for line in (0, 1, 2)]  # one, 24 and 47 days after the order
    details = pd.DataFrame({
        "l_orderkey": [n for n, _, _ in late], "l_partkey": [5] * len(late), "l_suppkey": [3] * len(late),
        "l_linenumber": pd.Series([line for _, line, _ in late], dtype="int32"), "l_quantity": [1.0] * len(late),
        "l_shipdate": [day(at) for _, _, at in late],
    })
    part = pd.DataFrame({"p_partkey": [5], "p_name": ["ring"], "p_retailprice": [9.5]})
    for name, frame in (("orders", orders), ("lineitem", details), ("part", part)):
        Feed(tmp_path / f"{name}.parquet").add(frame)
    shared = shared_folder(spark)
    before = set(os.listdir(shared.removeprefix("file://")))
    rows = entry_points.queries()["stream_sale_detail_late"](spark, str(tmp_path)).collect()
    expected = {f"{n}-{line}-{day(at):%Y-%m-%d}-5-3" for n, line, at in late if line < 2}
    assert sorted(r["order_detail_id"] for r in rows) == sorted(expected)
    assert {(r["sku_name"], r["sku_price"]) for r in rows} == {("ring", 9.5)}
    [own] = [f for f in os.listdir(shared.removeprefix("file://")) if f not in before and f.startswith("stream-sales-late")]
    assert not os.path.exists(f"{shared.removeprefix('file://')}/{own}/checkpoint/state")
    held = spark.read.parquet(f"{shared}/{own}/held/1").select("arrived").agg(F.count("*"), F.min("arrived"), F.max("arrived")).first()
    assert 0 < held[0] < 0.1 * (len(orders) + len(details))
    assert held[2] - held[1] <= (90 + 20 + 4) * 86_400_000_000  # 60 days, 30 days, and how far details are ahead
