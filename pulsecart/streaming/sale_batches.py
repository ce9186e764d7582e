"""The interval join of :mod:`pulsecart.streaming.sales`, batch by batch.

A stream join puts every row into its state and takes it out again, also those whose time is over before the
batch ends. Here the rows of a batch meet each other and those held from before in one join of a batch, which
spills and splits hot orders. Only rows that a later batch may still need are held, as files.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulsecart.functions import seconds_in
from pulsecart.schemas import JOIN_TOLERANCE

_ORDER, _DETAIL = 0, 1


def both_sides(orders: DataFrame, details: DataFrame, order_time: str, detail_time: str) -> DataFrame:
    """Both sides as one stream of rows; those without a time are left out."""

    def side(rows: DataFrame, number: int, time: str) -> DataFrame:
        known = rows.where(F.col(time).isNotNull())
        of = lambda n, all_rows: F.struct(*all_rows.columns) if n == number else F.lit(None).cast(all_rows.schema)
        return known.select(
            F.lit(number).alias("side"), F.unix_micros(time).alias("arrived"),
            of(_ORDER, orders).alias("o"), of(_DETAIL, details).alias("d"),
        )

    return side(orders, _ORDER, order_time).unionByName(side(details, _DETAIL, detail_time))


def holding_sink(
    folder: str,
    pair: Callable[[DataFrame, DataFrame, int], None],
    as_orders: Callable[[DataFrame], DataFrame],
    as_details: Callable[[DataFrame], DataFrame],
    tolerance: str = JOIN_TOLERANCE,
    delay: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for rows of :func:`both_sides`.

    ``as_orders`` and ``as_details`` make the records of the rows, and ``pair`` gets those of a batch together with
    those held, told apart by ``held``, for :func:`pulsecart.streaming.sales.live_pairs`. ``tolerance`` and ``delay``
    are as for that: rows are held until the newest rows of both streams are ``delay`` and the tolerance ahead of
    them. A row that is later than the delay meets what is still held.

    What is held lies below ``folder``, a version for each batch. A batch that is repeated reads the version
    before it once more and replaces its own, so ``pair`` has to replace what it wrote under that batch number, too.
    """
    reach = seconds_in(tolerance) * 1_000_000
    behind = max(reach, seconds_in(delay or tolerance) * 1_000_000)

    def version(batch_id: int) -> str:
        return f"{folder}/held/{batch_id}"

    def newest(rows: DataFrame) -> tuple[int | None, int | None]:
        of = lambda side: F.max(F.when(F.col("side") == side, F.col("arrived")))
        return tuple(rows.agg(of(_ORDER), of(_DETAIL)).first())

    def sink(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        parts = [(batch, False)]
        if batch_id > 0:
            parts.append((own.read.schema(batch.schema).parquet(version(batch_id - 1)), True))

        def records(number: int, name: str, as_records: Callable[[DataFrame], DataFrame]) -> DataFrame:
            of_side = [(rows.where(F.col("side") == number).select(f"{name}.*"), held) for rows, held in parts]
            return reduce(DataFrame.unionByName, [as_records(rows).withColumn("held", F.lit(held)) for rows, held in of_side])

        pair(records(_ORDER, "o", as_orders), records(_DETAIL, "d", as_details), batch_id)
        rows = reduce(DataFrame.unionByName, [rows for rows, _ in parts])
        # The newest row of either side is always held, so these are the newest of all batches.
        reached = newest(rows)
        if None not in reached:
            rows = rows.where(F.col("arrived") >= min(reached) - behind - reach)
        rows.write.mode("overwrite").parquet(version(batch_id))
        path = own._jvm.org.apache.hadoop.fs.Path(version(batch_id - 2))
        path.getFileSystem(own._jsc.hadoopConfiguration()).delete(path, True)  # no batch can be repeated from it

    return sink
