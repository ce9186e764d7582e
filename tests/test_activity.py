import random

import pytest
from pyspark.sql import functions as F

from pulsecart.functions import day_text, hour_text, time_of
from pulsecart.operators import activity as A

DAY_MS = 86_400_000
T0 = 1705276800000  # 2024-01-15 00:00:00


def startup(spark, rows):
    """Rows of (mid, ts, tie)."""
    df = spark.createDataFrame(rows, "mid string, ts bigint, tie bigint")
    text = lambda n: F.lit(None).cast("string").alias(n)
    return df.select(
        "mid", F.concat(F.lit("u"), "tie").alias("uid"),
        *[text(n) for n in ("appid", "area", "os", "ch", "type", "vs")],
        "ts", "tie", day_text(time_of("ts")).alias("logdate"), hour_text(time_of("ts")).alias("loghour"),
        time_of("ts").alias("event_time"),
    )


def winners(df):
    return sorted((r["mid"], r["logdate"], r["uid"]) for r in df.collect())


def test_first_row_per_device_and_day(spark):
    rows = [("a", T0 + 50, 1), ("a", T0 + 10, 2), ("a", T0 + DAY_MS, 3), ("b", T0 + 10, 4)]
    assert winners(A.first_rows(startup(spark, rows), ["tie"])) == [
        ("a", "2024-01-15", "u2"), ("a", "2024-01-16", "u3"), ("b", "2024-01-15", "u4"),
    ]


def test_day_boundary(spark):
    rows = [("a", T0 - 1, 1), ("a", T0, 2)]
    assert winners(A.first_rows(startup(spark, rows), ["tie"])) == [
        ("a", "2024-01-14", "u1"), ("a", "2024-01-15", "u2"),
    ]


@pytest.mark.parametrize("tie", [["tie"], []])
def test_equal_times_take_the_lowest_tie_break_in_any_order(spark, tie):
    rows = [("a", T0, t) for t in (3, 1, 2)] + [("b", T0, t) for t in (9, 8)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert winners(A.first_rows(startup(spark, rows).repartition(3), tie)) == [
            ("a", "2024-01-15", "u1"), ("b", "2024-01-15", "u8"),
        ]


def test_seen_devices_are_dropped_for_their_day_only(spark):
    seen = A.seen_devices(startup(spark, [("a", T0, 1), ("a", T0 + 5, 2)]))
    assert seen.count() == 1
    rows = startup(spark, [("a", T0 + 10, 3), ("a", T0 + DAY_MS, 4), ("b", T0 + 9, 6), ("b", T0 + 8, 5)])
    assert winners(A.newly_active(rows, seen, ["tie"])) == [
        ("a", "2024-01-16", "u4"), ("b", "2024-01-15", "u5"),
    ]


def test_stage_counts(spark):
    seen = startup(spark, [("a", T0, 1)])
    rows = startup(spark, [("a", T0 + 1, 2), ("b", T0 + 2, 3), ("b", T0 + 3, 4)])
    assert [tuple(r) for r in A.stage_counts(rows, A.seen_devices(seen)).collect()] == [
        ("2024-01-15", 3, 2, 1)
    ]


def daily(spark, rows):
    return spark.createDataFrame(rows, "mid string, logdate string, loghour string")


def test_hours_are_zero_filled_for_both_days(spark):
    rows = [("a", "2024-01-15", "03"), ("b", "2024-01-15", "03"), ("a", "2024-01-14", "23"),
            ("a", "2024-01-13", "05")]
    hours = {r["loghour"]: (r["today"], r["yesterday"])
             for r in A.today_vs_yesterday(daily(spark, rows), "2024-01-15").collect()}
    assert len(hours) == 24
    assert hours["03"] == (2, 0) and hours["23"] == (0, 1) and hours["05"] == (0, 0)


def test_hours_without_any_data(spark):
    rows = A.today_vs_yesterday(daily(spark, []), "2024-01-15").collect()
    assert len(rows) == 24 and all(r["today"] == r["yesterday"] == 0 for r in rows)


def test_totals_hours_and_map(spark):
    df = daily(spark, [("a", "2024-01-15", "03"), ("b", "2024-01-15", "03"), ("c", "2024-01-15", "09"),
                       ("a", "2024-01-14", "01")])
    assert A.total(df, "2024-01-15").first()[0] == 3
    assert A.total(df, "2024-02-15").first()[0] == 0
    assert A.hour_map(df, "2024-01-15").first()[0] == {"03": 2, "09": 1}


def test_kpis_and_new_devices(spark):
    df = daily(spark, [("a", "2024-01-14", "00"), ("a", "2024-01-15", "00"), ("b", "2024-01-15", "00"),
                       ("c", "2024-01-16", "00")])
    assert [tuple(r) for r in A.kpis(df, "2024-01-15").collect()] == [
        ("new_mid", "新增设备", 1), ("dau", "新增日活", 2),
    ]
    assert {tuple(r) for r in A.new_devices(df).collect()} == {
        ("2024-01-14", 1), ("2024-01-15", 1), ("2024-01-16", 1),
    }


def test_day_over_day(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 0), ("2024-01-02", 4), ("2024-01-03", 5), ("2024-01-05", 1)],
        "logdate string, total bigint",
    )
    assert sorted(tuple(r) for r in A.day_over_day(df).collect()) == [
        ("2024-01-01", 0, None, None), ("2024-01-02", 4, 0, None), ("2024-01-03", 5, 4, 0.25),
        ("2024-01-05", 1, None, None),
    ]


def test_active_behaviour(spark):
    df = spark.createDataFrame(
        [(1, "s", None, None), (2, None, "home", None), (3, None, "item", "home"), (4, None, None, None)],
        "id int, start string, page string, last_page_id string",
    )
    assert [r["id"] for r in A.active_behaviour(df).collect()] == [1, 2]
