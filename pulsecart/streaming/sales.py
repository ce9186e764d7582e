"""Sale details on a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsecart.functions import seconds_in
from pulsecart.operators.sales import pair_within, wide_rows, with_user
from pulsecart.schemas import JOIN_TOLERANCE
from pulsecart.sinks.keyed_table import KeyedTable

SALE_DETAIL = (
    "order_detail_id string, order_id string, order_status string, create_time string, "
    "user_id string, sku_id string, user_gender string, user_age int, user_level string, "
    "sku_price double, sku_name string, dt string"
)


def _watermarked(df: DataFrame, delay: str | None, tolerance: str) -> DataFrame:
    """A row that is as late as the tolerance may still find its partner, so no shorter delay is taken."""
    if delay is None or seconds_in(delay) < seconds_in(tolerance):
        delay = tolerance
    return df.withWatermark("ingest_time", delay)


def live_pairs(
    orders: DataFrame,
    details: DataFrame,
    tolerance: str = JOIN_TOLERANCE,
    delay: str | None = None,
    how: str = "inner",
    salts: int = 1,
) -> DataFrame:
    """Order and detail pairs from two streams; state older than the tolerance is dropped.

    ``delay`` is how far a row may lie behind the newest one of its stream; it is the tolerance at
    least.

    Set ``salts`` when single orders can hold a large part of the details.
    """
    sides = _watermarked(orders, delay, tolerance), _watermarked(details, delay, tolerance)
    return pair_within(*sides, tolerance, how, salts)


def live_sale_details(
    orders: DataFrame,
    details: DataFrame,
    tolerance: str = JOIN_TOLERANCE,
    delay: str | None = None,
    salts: int = 1,
) -> DataFrame:
    """Sale details, still without the user, as soon as both sides have arrived."""
    return wide_rows(live_pairs(orders, details, tolerance, delay, salts=salts))


def live_unmatched(
    orders: DataFrame, details: DataFrame, tolerance: str = JOIN_TOLERANCE, delay: str | None = None
) -> DataFrame:
    """Rows of either side whose time for a partner has run out."""
    pairs = live_pairs(orders, details, tolerance, delay, "full_outer")
    alone = pairs.filter(F.col("o_id").isNull() | F.col("d_id").isNull())
    return alone.select(
        F.when(F.col("d_id").isNull(), "order").otherwise("detail").alias("side"),
        F.coalesce("o_id", "d_order_id").alias("order_id"),
        F.col("d_id").alias("order_detail_id"),
    )


def sale_table(spark: SparkSession, path: str, part_length: int = 10) -> KeyedTable:
    """The sale-detail table: one row per detail, stored by order day, or by month with 7."""
    return KeyedTable(
        spark, path, SALE_DETAIL, ["order_detail_id"], day_column="dt", part_length=part_length
    )


def enriching_sink(
    table: KeyedTable, users: Callable[[], DataFrame], as_of: str, writer: str
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that adds the buyer and upserts by detail id.

    ``users`` is called for every batch, so it can return the user snapshot as it is then. A
    snapshot that is too large to scan that often is better persisted by the caller and read anew
    at longer intervals.
    """

    def sink(sales: DataFrame, batch_id: int) -> None:
        table.write(with_user(sales, users(), as_of), writer, batch_id)

    return sink
