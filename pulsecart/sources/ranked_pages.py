"""Hits stored in the order of their pages, so that a deep page costs as much as the first one."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pulsecart.schemas import PAGE_SIZES

_RANGE, _AT = "_range", "_at"
_IN_TASK = (1 << 33) - 1  # the lower bits of a generated id count the rows of a task


class RankedPages:
    """Hits cut into ranges of their order; each row knows its place within its range.

    The number of rows before each range is kept besides, one number for each range. A page is then the rows
    at known places of one range or of a few: other ranges are pruned as folders, and other places of a
    range by the statistics of its files. Nothing is skipped over, however deep the page.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._counts: list[tuple[int, int]] | None = None

    def write(self, found: DataFrame, order: Sequence[str], ranges: int) -> RankedPages:
        """Store the hits. ``order`` ends with a column that tells equal rows apart, so that pages are stable and
        ranges stay even; nulls come first. ``ranges`` suits the size: a range is sorted by one task.
        """
        place = F.monotonically_increasing_id()
        rows = found.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(_AT, place)
        rows = rows.withColumn(_RANGE, F.shiftright(_AT, 33)).withColumn(_AT, F.col(_AT).bitwiseAND(F.lit(_IN_TASK)))
        rows.write.mode("error").partitionBy(_RANGE).parquet(f"{self.path}/hits")
        stored = self.spark.read.schema(f"{_AT} bigint, {_RANGE} bigint").parquet(f"{self.path}/hits")
        stored.groupBy(_RANGE).count().coalesce(1).write.mode("error").parquet(f"{self.path}/counts")
        self.schema, self.order, self._counts = found.schema, list(order), None
        return self

    def _starts(self) -> tuple[list[int], list[int]]:
        """Ranges with rows in their order, and the number of rows before each and in all."""
        if self._counts is None:
            counts = self.spark.read.schema(f"{_RANGE} bigint, count bigint").parquet(f"{self.path}/counts")
            self._counts = sorted(tuple(r) for r in counts.collect())  # one row for each range
        return [r for r, _ in self._counts], [0, *accumulate(n for _, n in self._counts)]

    def total(self) -> int:
        """Number of hits."""
        return self._starts()[1][-1]

    def rows(self, start: int, size: int) -> DataFrame:
        """Hits ``start`` to ``start + size`` in order, fewer at the end."""
        ranges, starts = self._starts()
        last = min(start + size, starts[-1]) - 1
        layout = StructType([*self.schema, StructField(_AT, LongType()), StructField(_RANGE, LongType())])
        hits = self.spark.read.schema(layout).parquet(f"{self.path}/hits")
        wanted = F.lit(False)
        if start <= last:
            for i in range(bisect_right(starts, start) - 1, bisect_right(starts, last)):
                place = F.col(_AT).between(max(0, start - starts[i]), last - starts[i])
                wanted = wanted | ((F.col(_RANGE) == ranges[i]) & place)
        return hits.where(wanted).orderBy(*self.order).drop(_AT, _RANGE)

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number``, counted from 1, of one of the offered page sizes."""
        if number < 1 or size not in PAGE_SIZES:
            raise ValueError(f"page number from 1 and page size of {PAGE_SIZES} expected")
        return self.rows((number - 1) * size, size)
