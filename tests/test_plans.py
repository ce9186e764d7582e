"""Physical plans: what reaches the scan, what must never appear, and hot keys."""

import contextlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from pulsecart.operators import sales as SD
from pulsecart.plans import all_queries
from pulsecart.plans.activity import FILLED
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.workspace import materialise, run_folder

FOLDER = "/root/testdata/sf0.001"
BATCH = sorted(n for n in all_queries() if not n.startswith("stream_"))
FEW_ROWS = ["sales_value_bands"]  # its window holds one row per province
NEVER = ["CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas", "Window ["]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_plan_has_a_cross_join_python_or_a_window(spark, name):
    text = plan(entry_points.queries()[name](spark, FOLDER))
    few = ["Window ["] if name in FEW_ROWS else []
    assert [n for n in NEVER if n in text] == few


def test_day_queries_scan_two_columns_of_their_days(spark):
    text = plan(entry_points.queries()["dau_by_hour"](spark, FOLDER))
    assert "ReadSchema: struct<ts:timestamp,user_id:bigint>" in text
    assert "GreaterThanOrEqual(ts,2024-01-15" in text and "LessThan(ts,2024-01-16" in text


def test_counting_stays_in_hash_aggregates(spark):
    for name in ("dau_total", "dau_by_hour", "dau_today_vs_yesterday", "dau_new_devices", "dau_kpis"):
        assert "SortAggregate" not in plan(entry_points.queries()[name](spark, FOLDER))


def test_today_vs_yesterday_shuffles_twice(spark):
    assert plan(entry_points.queries()["dau_today_vs_yesterday"](spark, FOLDER)).count("Exchange ") == 2


def test_terms_reach_the_scan(spark):
    assert "EqualTo(p_brand," in plan(entry_points.queries()["search_total"](spark, FOLDER))


def test_top_terms_and_pages_are_partial_sorts(spark):
    for name in ("search_terms_max", "search_hits_page", "sale_page"):
        assert "TakeOrderedAndProject" in plan(entry_points.queries()[name](spark, FOLDER))


def test_one_day_of_a_stored_table_reads_one_folder(spark):
    df = entry_points.queries()["daily_active_scan"](spark, FOLDER)
    files = df.inputFiles()
    assert 1 <= len(files) < 3 and all("_part=2024-01-15" in f for f in files)
    assert df.columns == FILLED


@contextlib.contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_materialised_results_are_broadcast_by_their_size(spark):
    big = spark.range(1000).withColumn("x", F.col("id") * 2)
    small = materialise(spark.range(10), "small")
    assert "BroadcastHashJoin" in plan(big.join(small, "id"))
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="100"):
        assert "BroadcastHashJoin" not in plan(big.join(small, "id"))


def skewed(spark):
    """A third of all details belong to one order."""
    n = 30_000
    when = F.timestamp_seconds(F.lit(1705276800) + F.col("id") % 200)
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 5000))
    orders = spark.range(5000).select(
        F.concat(F.lit("o"), "id").alias("id"), F.lit("u").alias("user_id"), F.lit("s").alias("order_status"),
        F.lit("2024-01-15 00:00:00").alias("create_time"), when.alias("ingest_time"),
    )
    hot = orders.limit(1).withColumn("id", F.lit("hot"))
    details = spark.range(0, n, 1, 8).select(
        F.concat(F.lit("d"), "id").alias("id"), key.alias("order_id"), when.alias("ingest_time"),
        F.sha2(F.col("id").cast("string"), 256).alias("note"),
    )
    return orders.unionByName(hot), details


def test_hot_order_is_split_and_no_row_is_lost(spark):
    orders, details = (materialise(df, "skew") for df in skewed(spark))
    expected = orders.alias("o").join(
        details.alias("d"),
        (F.col("o.id") == F.col("d.order_id"))
        & (F.abs(F.unix_seconds("o.ingest_time") - F.unix_seconds("d.ingest_time")) <= 100),
    ).count()
    with settings(
        spark,
        spark__sql__shuffle__partitions="6",
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="20KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="50KB",
    ):
        pairs = SD.pair_within(orders, details)
        rows = pairs.collect()
        assert len(rows) == expected
        assert "skew=true" in plan(pairs)
        everything = SD.pairs_and_alone(orders, details)
        assert everything.count() == expected + SD.unmatched(orders, details).count()
        assert SD.pair_within(orders, details, salts=4).count() == expected
        kept = orders.join(details, (orders.id == details.order_id), "full_outer")
        assert kept.count() >= details.count()


def test_hot_day_is_written_by_several_tasks(spark):
    rows = spark.range(0, 30_000, 1, 8).select(
        F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("note"),
        F.when(F.col("id") % 10 == 0, "2024-01-14").otherwise("2024-01-15").alias("dt"),
    )
    table = KeyedTable(spark, run_folder(spark, "hot"), "id string, note string, dt string", ["id"], "dt")
    with settings(spark, spark__sql__adaptive__advisoryPartitionSizeInBytes="200KB"):
        table.write(rows, "w", 0, unique=True)
    assert table.read().count() == 30_000
    assert len(table.read(["2024-01-15"]).inputFiles()) > 2
    assert len(table.read(["2024-01-14"]).inputFiles()) <= 2
