from datetime import date, datetime

from pyspark.sql import functions as F

from pulsecart import functions as fn


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(*columns).first()


def test_day_and_hour_of_epoch(spark):
    ms = 1705363199999  # 2024-01-15 23:59:59.999
    for value, day, hour in ((ms, "2024-01-15", "23"), (ms + 1, "2024-01-16", "00")):
        row = one(spark, fn.day_text(fn.time_of("ts")), fn.hour_text(fn.time_of("ts")), ts=value)
        assert tuple(row) == (day, hour)


def test_create_parts(spark):
    date_, hour = fn.create_parts("t")
    assert tuple(one(spark, date_, hour, t="2021-04-22 07:05:09")) == ("2021-04-22", "07")


def test_day_before(spark):
    assert one(spark, fn.day_before("2024-03-01"))[0] == "2024-02-29"


def test_within_days_includes_both_ends(spark):
    times = ["2024-01-14 23:59:59.999999", "2024-01-15", "2024-01-16 23:59:59.999999", "2024-01-17"]
    df = spark.createDataFrame([(datetime.fromisoformat(t),) for t in times], "t timestamp_ntz")
    kept = df.select(F.col("t").cast("timestamp").alias("t")).filter(
        fn.within_days("t", "2024-01-15", "2024-01-16")
    )
    assert kept.count() == 2


def test_seconds_in():
    assert [fn.seconds_in(t) for t in ("1 second", "5 minutes", "6 hours", "30 days")] == [
        1, 300, 21600, 2592000,
    ]


def test_age_counts_365_day_years(spark):
    ages = spark.createDataFrame(
        [("1990-06-05",), ("2024-05-31",), ("2025-06-02",), ("no date",), (None,)], "b string"
    ).select(fn.age_years("b", "2024-06-01"))
    assert [r[0] for r in ages.collect()] == [34, 0, -1, None, None]


def test_age_bands(spark):
    df = spark.createDataFrame([(a,) for a in (0, 19, 20, 29, 30, 70, None)], "a int")
    assert [r[0] for r in df.select(fn.age_band("a")).collect()] == [
        "20岁以下", "20岁以下", "20-30岁", "20-30岁", "30岁以上", "30岁以上", None,
    ]


def test_gender_label(spark):
    df = spark.createDataFrame([("M",), ("F",), ("X",), (None,)], "g string")
    assert [r[0] for r in df.select(fn.gender_label("g")).collect()] == ["男", "女", "X", None]


def test_tokens_split_han_and_words(spark):
    row = one(spark, fn.tokens("t"), t="篮球,Foot-ball 42 足球")
    assert row[0] == ["篮", "球", "foot", "ball", "42", "足", "球"]


def test_match_is_any_token_and_never_a_part(spark):
    df = spark.createDataFrame(
        [("small ring",), ("string",), ("RING bolt",), ("篮球,足球",), (None,)], "t string"
    )
    match = lambda w: [r[0] for r in df.select(fn.has_any_token("t", w)).collect()]
    assert match("ring") == [True, False, True, False, False]
    assert match("球") == [False, False, False, True, False]
    assert match("bolt small") == [True, False, True, False, False]
    assert match("") == [False] * 5


def test_price(spark):
    df = spark.createDataFrame([("12.50",), ("free",), (None,)], "p string")
    assert [r[0] for r in df.select(fn.price("p")).collect()] == [12.5, None, None]


def test_bucket_ids_do_not_collide(spark):
    df = spark.createDataFrame([("m1", 23 * 60000 + 59999), ("m12", 3 * 60000)], "m string, t bigint")
    assert [r[0] for r in df.select(fn.bucket_id("m", "t", 60)).collect()] == ["m1_23", "m12_3"]


def test_equality_with_missing_value_is_false(spark):
    df = spark.createDataFrame([("clickItem",), ("x",), (None,)], "e string")
    assert [r[0] for r in df.select(fn.equals_text("e", "clickItem")).collect()] == [
        True, False, False,
    ]


def test_parse_records(spark):
    texts = [
        '{"mid":"m1","ts":5,"unknown":1}',
        '{"mid":7,"ts":"6"}',
        '{"mid":null}',
        '{"mid":"m1","ts":"soon"}',
        "{broken",
        None,
    ]
    parsed = fn.parse_records(
        spark.createDataFrame([(t,) for t in texts], "value string"), "mid string, ts bigint, v double"
    )
    good, bad = fn.split_corrupt(parsed)
    assert [tuple(r) for r in good.collect()] == [("m1", 5, 0.0), ("7", 6, 0.0), (None, 0, 0.0)]
    assert [r[0] for r in bad.collect()] == ['{"mid":"m1","ts":"soon"}', "{broken", ""]


def test_after_image_json(spark):
    df = spark.createDataFrame(
        [([("id", "1"), ("name", "a"), ("name", "b"), ("note", None)],)],
        "c array<struct<name: string, value: string>>",
    )
    assert df.select(fn.after_image_json("c")).first()[0] == '{"id":"1","name":"b","note":""}'


def test_hour_spine(spark):
    assert [r[0] for r in fn.hour_spine(spark).collect()] == [f"{h:02d}" for h in range(24)]


def test_dates_come_back_as_dates(spark):
    assert one(spark, F.to_date(fn.day_text("d")), d=date(2024, 2, 29))[0] == date(2024, 2, 29)
