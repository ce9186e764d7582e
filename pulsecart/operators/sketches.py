"""Top terms from summaries that are made once for each day, or other group, and merged for any set of them.

:func:`pulsecart.operators.search.top_terms` is exact and scans all hits. A summary has a bounded size, so the
top terms of a year are merged from its days without their hits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

TRACKED = 10_000  # values that a summary counts at once


def _error_share(tracked: int) -> float:
    """Most that a count may be too high, as a share of all hits: 3.5 by the size of the summary's hash map, which
    is the power of two that holds the tracked values at a load of 3/4."""
    return 3.5 / 2 ** math.ceil(math.log2(tracked / 0.75))


def term_sketches(found: DataFrame, groups: Sequence[str], field: str, tracked: int = TRACKED) -> DataFrame:
    """The columns of ``groups``, a summary of the values of ``field`` (``terms``), and the number of hits that have
    one (``hits``). Groups without any value have no row. A hot value or group is summed up in each task first.
    """
    known = found.where(F.col(field).isNotNull()).withColumn("_value", F.col(field))
    return known.groupBy(*groups).agg(
        F.expr(f"approx_top_k_accumulate(_value, {tracked})").alias("terms"), F.count("*").alias("hits")
    )


def merged_terms(sketches: DataFrame, size: int = 10, tracked: int = TRACKED) -> DataFrame:
    """The most frequent values over all the rows of :func:`term_sketches` given; nothing for no rows.

    Columns: the value (``item``), its count (``doc_count``) and by how much the count may be too high
    (``error``). It is never too low. Counts are exact as long as no summary meets more than three quarters of
    its map in distinct values; ``error`` is what holds in any case. Equal counts are ordered by value.
    """
    # A key, as a task without rows would otherwise hand on an empty summary, which cannot be merged.
    whole = sketches.groupBy(F.lit(0).alias("_all")).agg(
        F.expr(f"approx_top_k_combine(terms, {tracked})").alias("terms"), F.sum("hits").alias("hits")
    )
    items = whole.select("hits", F.explode(F.expr(f"approx_top_k_estimate(terms, {tracked})")).alias("t"))
    error = F.floor(F.col("hits") * F.lit(_error_share(tracked))).cast("bigint")
    found = items.select(F.col("t.item").alias("item"), F.col("t.count").alias("doc_count"), error.alias("error"))
    return found.orderBy(F.desc("doc_count"), "item").limit(size)
