from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pulsecart.functions import time_of
from pulsecart.operators import sales as SD

T0 = 1705276800


def at(seconds):
    return (T0 + seconds) * 1000


def orders(spark, rows):
    """Rows of (id, user, arrival second)."""
    df = spark.createDataFrame([(i, u, at(t)) for i, u, t in rows], "id string, user_id string, ts bigint")
    return df.select(
        "id", "user_id", F.lit("1001").alias("order_status"),
        F.lit("2024-01-15 08:00:00").alias("create_time"), time_of("ts").alias("ingest_time"),
    )


def details(spark, rows):
    """Rows of (id, order, price, arrival second)."""
    df = spark.createDataFrame(
        [(i, o, p, at(t)) for i, o, p, t in rows], "id string, order_id string, order_price string, ts bigint"
    )
    return df.select(
        "id", "order_id", F.lit("7").alias("sku_id"), F.lit("ring").alias("sku_name"), "order_price",
        time_of("ts").alias("ingest_time"),
    )


def ids(df):
    return sorted(r["order_detail_id"] for r in df.collect())


def test_either_side_may_come_first(spark):
    o = orders(spark, [("o1", "u", 0), ("o2", "u", 50), ("o3", "u", 0), ("o4", "u", 0)])
    d = details(spark, [
        ("d1", "o1", "1", 100), ("d2", "o1", "1", 0), ("d3", "o1", "1", 30), ("d4", "o2", "1", 0),
        ("d5", "o3", "1", 101), ("d6", "none", "1", 0),
    ])
    assert ids(SD.sale_details(o, d)) == ["d1", "d2", "d3", "d4"]
    lost = sorted((r["side"], r["order_id"], r["order_detail_id"]) for r in SD.unmatched(o, d).collect())
    assert lost == [
        ("detail", "none", "d6"), ("detail", "o3", "d5"), ("order", "o3", None), ("order", "o4", None),
    ]


def test_repeated_order_delivery_gives_each_detail_once(spark):
    o = orders(spark, [("o1", "u", 0), ("o1", "u", 40)])
    d = details(spark, [("d1", "o1", "1", 20), ("d2", "o1", "1", 130)])
    assert ids(SD.sale_details(o, d)) == ["d1", "d1", "d2"]
    assert ids(SD.one_per_detail(SD.sale_details(o, d))) == ["d1", "d2"]


def test_wide_row(spark):
    o = orders(spark, [("o1", "u1", 0)])
    d = details(spark, [("d1", "o1", "9.5", 0), ("d2", "o1", "n/a", 0), ("d3", "o1", None, 0)])
    rows = {r["order_detail_id"]: r for r in SD.sale_details(o, d).collect()}
    assert [rows[i]["sku_price"] for i in ("d1", "d2", "d3")] == [9.5, None, None]
    assert (rows["d1"]["dt"], rows["d1"]["order_id"], rows["d1"]["sku_name"]) == ("2024-01-15", "o1", "ring")


def test_missing_detail_leaves_defaults(spark):
    pairs = SD.pair_within(orders(spark, [("o1", "u1", 0)]), details(spark, []), how="full_outer")
    row = SD.wide_rows(pairs).first()
    assert (row["order_id"], row["order_detail_id"], row["sku_price"]) == ("o1", None, 0.0)


def test_user_enrichment(spark):
    o = orders(spark, [("o1", "u1", 0), ("o2", "u2", 0)])
    d = details(spark, [("d1", "o1", "1", 0), ("d2", "o2", "1", 0)])
    users = spark.createDataFrame(
        [("u1", "n", "3", "1990-06-05", "F")],
        "id string, login_name string, user_level string, birthday string, gender string",
    )
    rows = {r["order_detail_id"]: r for r in SD.with_user(SD.sale_details(o, d), users, "2024-06-01").collect()}
    assert (rows["d1"]["user_gender"], rows["d1"]["user_age"], rows["d1"]["user_level"]) == ("F", 34, "3")
    assert (rows["d2"]["user_gender"], rows["d2"]["user_age"], rows["d2"]["user_level"]) == (None, 0, None)


def test_splits(spark):
    df = spark.createDataFrame(
        [("M", 19), ("M", 20), ("F", 29), ("F", 30)], "user_gender string, user_age int"
    )
    assert {tuple(r) for r in SD.gender_split(df).collect()} == {("M", 2, 0.5), ("F", 2, 0.5)}
    assert {tuple(r) for r in SD.age_split(df).collect()} == {
        ("20岁以下", 1, 0.25), ("20-30岁", 2, 0.5), ("30岁以上", 1, 0.25),
    }


def test_gross_value_is_exact(spark):
    df = spark.createDataFrame(
        [("2024-01-15 08:00:00", 0.1)] * 3 + [("2024-01-15 09:00:00", 1.0), ("2024-01-16 08:10:00", 2.0)],
        "create_time string, total_amount double",
    )
    assert {tuple(r) for r in SD.gross_value(df).collect()} == {
        ("2024-01-15", 1.3, 4), ("2024-01-16", 2.0, 1),
    }
    assert ("2024-01-15", "08", 0.3, 3) in {tuple(r) for r in SD.gross_value(df, hourly=True).collect()}


def test_value_bands(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 99, 100, 599, 600, 601)], "v int")
    assert [r["band"] for r in SD.with_value_band(df, "v").collect()] == [None, 0, 0, 1, 5, 5, 5]


arrival = st.integers(0, 400)
key = st.sampled_from(["hot", "hot", "hot", "a", "b"])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(key, arrival), max_size=8, unique=True), st.lists(st.tuples(key, arrival), max_size=15))
def test_join_equals_brute_force(spark, order_rows, detail_rows):
    o = [(k, "u", t) for k, t in order_rows]
    d = [(f"d{i}", k, "1", t) for i, (k, t) in enumerate(detail_rows)]
    near = [(a, b) for a in o for b in d if a[0] == b[1] and abs(a[2] - b[3]) <= 100]
    left, right = orders(spark, o), details(spark, d)
    assert ids(SD.sale_details(left, right)) == sorted(b[0] for _, b in near)
    lost = sorted(str(r["order_detail_id"] or r["order_id"]) for r in SD.unmatched(left, right).collect())
    met_orders, met_details = {a for a, _ in near}, {b for _, b in near}
    expected = [a[0] for a in o if a not in met_orders] + [b[0] for b in d if b not in met_details]
    assert lost == sorted(expected)


def test_times_are_instants(spark):
    first = orders(spark, [("o", "u", 0)]).first()["ingest_time"]
    assert first - datetime(2024, 1, 15) in {timedelta(hours=h) for h in range(-14, 15)}
