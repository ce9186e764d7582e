"""First days kept up batch by batch, and pages of stored ranges."""

import random

import pytest

from pulsecart.operators import activity as A
from pulsecart.operators import search as S
from pulsecart.sinks.first_seen import FirstSeen
from pulsecart.sources.ranked_pages import RankedPages
from pulsecart.workspace import run_folder

ACTIVE = "mid string, logdate string"


def counts(rows):
    return {r["logdate"]: r["new_devices"] for r in rows.collect()}


def test_first_seen_with_late_days_and_repeats(spark):
    first = FirstSeen(spark, run_folder(spark, "first-seen"), buckets=4)
    draw = random.Random(5)
    days = [f"2024-01-{d:02d}" for d in range(1, 10)]
    rows = [(f"m{draw.randrange(40)}", draw.choice(days)) for _ in range(120)]
    batches = [rows[:50] + rows[:5], rows[50:90], [], [(None, days[0]), ("m1", None)], rows[90:]]
    taken = []
    for n, batch in enumerate(batches):
        frame = spark.createDataFrame(batch, ACTIVE)
        first.merge(frame, "daily", n)
        first.merge(frame, "daily", n)
        taken += [r for r in batch if None not in r]
        assert counts(first.new_devices()) == counts(A.new_devices(spark.createDataFrame(taken, ACTIVE)))
    assert sum(counts(first.new_devices()).values()) == len({m for m, _ in taken})
    assert counts(first.new_devices(days[0])) == {days[0]: len({m for m, d in taken if d == days[0]})}


def test_a_repeat_after_a_crash_between_the_tables(spark):
    first = FirstSeen(spark, run_folder(spark, "first-seen"), buckets=2)
    frame = spark.createDataFrame([("a", "2024-01-02"), ("b", "2024-01-02")], ACTIVE)
    write, first.devices.write = first.devices.write, lambda *a, **k: 1 / 0
    with pytest.raises(ZeroDivisionError):
        first.merge(frame, "daily", 0)
    first.devices.write = write
    first.merge(frame, "daily", 0)
    first.merge(spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-03")], ACTIVE), "daily", 1)
    assert counts(first.new_devices()) == {"2024-01-01": 1, "2024-01-02": 1}


def test_merge_reads_the_buckets_of_its_devices(spark):
    first = FirstSeen(spark, run_folder(spark, "first-seen"))
    first.merge(spark.createDataFrame([(f"m{n}", "2024-01-01") for n in range(200)], ACTIVE), "daily", 0)
    asked = []
    read, first.devices.read = first.devices.read, lambda days=None, columns=None: asked.append(days) or read(days, columns)
    first.merge(spark.createDataFrame([("m7", "2024-01-02"), ("m7", "2024-01-03")], ACTIVE), "daily", 1)
    assert [len(a) for a in asked] == [1]
    assert counts(first.new_devices()) == {"2024-01-01": 200}


HITS = "key int, id int, name string"
ORDER = ["key", "id"]


@pytest.fixture(scope="module")
def hits(spark):
    draw = random.Random(6)
    rows = [(draw.choice([None, 1, 1, 1, 2, 3]), n, f"n{n}") for n in range(137)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, HITS).repartition(3)


def in_order(rows):
    return sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_all_pages_are_the_hits_in_order(spark, hits):
    pages = RankedPages(spark, run_folder(spark, "pages")).write(hits, ORDER, 7)
    assert pages.total() == 137
    shown = [[tuple(r) for r in pages.page(n, 20).collect()] for n in range(1, 9)]
    assert [len(p) for p in shown] == [20] * 6 + [17, 0]
    assert [r for p in shown for r in p] == in_order(hits)
    with pytest.raises(ValueError):
        pages.page(0, 20)


def test_a_page_reads_its_ranges_only(spark, hits, capsys):
    pages = RankedPages(spark, run_folder(spark, "pages")).write(hits, ORDER, 7)
    page = pages.page(20, 5)
    page.explain("formatted")
    plan = capsys.readouterr().out
    assert "Offset" not in plan and "PartitionFilters: [" in plan and "_at" in plan.split("PushedFilters")[1]
    assert len(page.inputFiles()) > 2  # the table has several ranges,
    ranges, starts = pages._starts()
    assert len(ranges) > 2 and starts[-1] == 137
    assert page.select("id").count() == 5  # and the page is whole


def test_pages_of_nothing(spark):
    pages = RankedPages(spark, run_folder(spark, "pages")).write(spark.createDataFrame([], HITS), ORDER, 3)
    assert pages.total() == 0 and pages.page(1, 10).collect() == []


def test_after_goes_through_all_hits(spark, hits):
    want, found, last = in_order(hits), [], None
    first = S.slice_hits(hits, ORDER, 0, 30).collect()
    found += [tuple(r) for r in first]
    while len(found) < len(want):
        page = [tuple(r) for r in S.after(hits, ORDER, found[-1][:2], 30).collect()]
        assert page
        found += page
    assert found == want and S.after(hits, ORDER, want[-1][:2], 30).collect() == []
    with pytest.raises(ValueError):
        S.after(hits, ORDER, (1,), 5)
