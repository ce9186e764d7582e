from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pulsecart.functions import time_of
from pulsecart.operators import alerts as AL

T0 = 1705276800000
MINUTE = 60_000


def log(spark, rows):
    """Rows of (mid, uid, evid, itemid, minutes after T0)."""
    df = spark.createDataFrame(
        [(m, u, e, i, int(T0 + t * MINUTE)) for m, u, e, i, t in rows],
        "mid string, uid string, evid string, itemid string, ts bigint",
    )
    return df.withColumn("event_time", time_of("ts"))


def coupons(mid, *uids, at=0.5):
    return [(mid, u, "coupon", f"i{u}", at) for u in uids]


def ends(df):
    return sorted(((r["ts"] - T0) // MINUTE, r["mid"]) for r in df.collect())


def test_three_accounts_raise_an_alert_in_each_window(spark):
    rows = coupons("d", "1", "2", "3") + [("d", "1", "view", None, 0.6), ("d", "1", "coupon", "i1", 0.7)]
    found = AL.coupon_alerts(log(spark, rows)).orderBy("ts").collect()
    assert [(r["ts"] - T0) // MINUTE for r in found] == [1, 2, 3, 4, 5]
    first = found[0]
    assert first["alert_id"] == f"d_{T0 // MINUTE + 1}"
    assert first["uids"] == ["1", "2", "3"] and first["itemIds"] == ["i1", "i2", "i3"]
    assert first["events"] == ["coupon"] * 4 + ["view"]
    assert first["dt"] == "2024-01-15"


@pytest.mark.parametrize(
    "rows",
    [
        coupons("d", "1", "2"),
        coupons("d", "1", "1", "1"),
        coupons("d", "1", "2", None),
        coupons("d", "1", "2", "3") + [("d", "9", "clickItem", "x", 0.5)],
        coupons("d", "1", "2") + coupons("e", "3"),
        [("d", u, "view", None, 0.5) for u in "123"],
        coupons("d", "1", "2", at=0.5) + coupons("d", "3", at=5.5),
    ],
    ids=["two", "one account", "missing account", "browsed", "two devices", "no coupon", "too far"],
)
def test_no_alert(spark, rows):
    assert AL.coupon_alerts(log(spark, rows)).count() == 0


def test_alert_starts_when_the_browse_event_leaves_the_window(spark):
    rows = [("d", "1", "clickItem", "x", 0.5)] + coupons("d", "1", "2", "3", at=4.5)
    assert ends(AL.coupon_alerts(log(spark, rows))) == [(m, "d") for m in (6, 7, 8, 9)]


def test_events_without_a_name_are_listed(spark):
    rows = coupons("d", "1", "2", "3") + [("d", "1", None, None, 0.5)]
    assert AL.coupon_alerts(log(spark, rows)).first()["events"] == [None] + ["coupon"] * 3


def test_throttle_keeps_the_last_of_a_bucket(spark):
    events = log(spark, coupons("d", "1", "2", "3") + coupons("e", "1", "2", "3", at=3.5))
    kept = AL.coupon_alerts(events, bucket="3 minutes")
    assert ends(kept) == [(2, "d"), (5, "d"), (5, "e"), (8, "e")]
    stored = AL.throttle(AL.describe_windows(
        events, AL.qualifying_windows(events), AL.ALERT_WINDOW, AL.SLIDE, "3 minutes"))
    assert sorted(map(str, stored.collect())) == sorted(map(str, kept.collect()))


def test_slide_below_the_bucket(spark):
    events = log(spark, coupons("d", "1", "2", "3"))
    fine = AL.coupon_alerts(events, slide="20 seconds")
    assert fine.count() == 15
    minutes = AL.coupon_alerts(events, slide="20 seconds", bucket="1 minute")
    assert len({r["alert_id"] for r in minutes.collect()}) == minutes.count() == 6


def test_window_that_is_no_multiple_of_the_slide(spark):
    assert AL.pane_length("5 minutes", "2 minutes") == "60 seconds"
    assert ends(AL.coupon_alerts(log(spark, coupons("d", "1", "2", "3")), slide="2 minutes")) == (
        brute(coupons("d", "1", "2", "3"), 5, 2)
    )


def brute(rows, window, slide):
    """Alerts by checking every window end near the events."""
    found = set()
    first, last = int(min(r[4] for r in rows)), int(max(r[4] for r in rows))
    start0 = T0 // MINUTE
    for start in range(first - window - slide, last + slide + 1):
        if (start0 + start) % slide:
            continue
        by_device = defaultdict(list)
        for r in rows:
            if start <= r[4] < start + window:
                by_device[r[0]].append(r)
        for mid, inside in by_device.items():
            uids = {r[1] for r in inside if r[2] == "coupon" and r[1] is not None}
            if len(uids) >= 3 and all(r[2] != "clickItem" for r in inside):
                found.add((start + window, mid))
    return sorted(found)


event = st.tuples(
    st.sampled_from(["d", "e"]), st.sampled_from(["1", "2", "3", "4", None]),
    st.sampled_from(["coupon", "coupon", "coupon", "clickItem", "view"]), st.sampled_from(["i", "j"]),
    st.integers(0, 40).map(lambda q: q / 4),
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(event, min_size=6, max_size=30), st.sampled_from([(5, 1), (4, 2), (5, 2)]))
def test_windows_equal_brute_force(spark, rows, shape):
    window, slide = shape
    windows = AL.qualifying_windows(log(spark, rows), f"{window} minutes", f"{slide} minutes")
    got = windows.select("mid", F.unix_millis("window.end").alias("ts"))
    assert ends(got) == brute(rows, window, slide)


def test_hot_device_is_counted_not_gathered(spark):
    """One device with most of the rows: the deciding plan holds no collected lists."""
    rows = coupons("hot", *[str(i % 50) for i in range(400)]) + coupons("d", "1", "2", "3")
    events = log(spark, rows)
    assert len(ends(AL.qualifying_windows(events).select("mid", F.unix_millis("window.end").alias("ts")))) == 10
    plan = AL.qualifying_windows(events)._jdf.queryExecution().toString()
    assert "collect_" not in plan
