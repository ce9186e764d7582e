"""Merged summaries of terms against exact counts."""

import random
from collections import Counter

import pytest

from pulsecart.operators.sketches import _error_share, merged_terms, term_sketches
from pulsecart.workspace import materialise

HITS = "day string, term string"


def hits(spark, values):
    draw = random.Random(3)
    return spark.createDataFrame([(f"d{draw.randrange(6)}", v) for v in values], HITS).repartition(4)


def test_few_values_are_counted_exactly(spark):
    values = ["a"] * 40 + ["b"] * 40 + ["c"] * 7 + [None] * 50
    sketches = materialise(term_sketches(hits(spark, values), ["day"], "term", 100), "sketches")
    found = merged_terms(sketches, 3, 100).collect()
    assert [(r["item"], r["doc_count"]) for r in found] == [("a", 40), ("b", 40), ("c", 7)]
    assert sum(r["hits"] for r in sketches.collect()) == 87


@pytest.mark.parametrize("days", [["d0"], ["d1", "d3", "d4"], [f"d{n}" for n in range(6)]])
def test_the_bound_holds_for_many_values(spark, days):
    draw = random.Random(4)
    values = [f"v{int(draw.paretovariate(0.7))}" for _ in range(20_000)]
    rows = hits(spark, values)
    sketches = term_sketches(rows, ["day"], "term", 96).where(rows["day"].isin(days))
    exact = Counter(r["term"] for r in rows.where(rows["day"].isin(days)).collect())
    found = merged_terms(sketches, 10, 96).collect()
    error = int(sum(exact.values()) * _error_share(96))
    assert len(exact) > 96 and len(found) == 10  # more values than a summary tracks
    for r in found:
        assert r["error"] == error and 0 <= r["doc_count"] - exact[r["item"]] <= error
    # No value that is more frequent than the last one shown, error and all, is missing.
    shown = {r["item"] for r in found}
    assert all(v in shown for v, n in exact.items() if n > found[-1]["doc_count"])


def test_nothing_to_merge(spark):
    sketches = term_sketches(spark.createDataFrame([("d", None)], HITS), ["day"], "term", 100)
    assert sketches.collect() == [] and merged_terms(sketches, 5, 100).collect() == []
