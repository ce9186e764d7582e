"""Order value per day and hour on a stream of changes, with retraction of what a change replaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsecart.functions import create_parts
from pulsecart.sinks.keyed_table import KeyedTable

_VALUE = "create_date string, create_hour string, gmv decimal(28,2), orders bigint"
ORDER = "struct<id:string,create_time:string,total_amount:double>"


def value_changes(changes: DataFrame) -> DataFrame:
    """What each change adds to and takes from its day and hour.

    ``changes`` has the order before and after as structs ``before`` and ``after`` (:data:`ORDER`): an insert
    has no before, a delete no after. Rows do not depend on each other, so changes may come in any order; an
    order whose time changes is taken from one hour and added to another.
    """
    images = F.array(F.struct(F.lit(-1).alias("sign"), F.col("before").alias("o")), F.struct(F.lit(1).alias("sign"), F.col("after").alias("o")))
    rows = changes.select(F.inline(F.filter(images, lambda i: i["o"].isNotNull())))
    date, hour = create_parts("o.create_time")
    amount = F.coalesce(F.col("o.total_amount").cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))
    return rows.select(date.alias("create_date"), hour.alias("create_hour"), (F.col("sign") * amount).alias("amount"), "sign")


def gross_value_so_far(changes: DataFrame) -> DataFrame:
    """Running order value and count of the hours that a batch touches, for update mode. Sums are exact to the
    cent, so a retraction leaves nothing behind. State is one row for each hour that ever had an order."""
    return value_changes(changes).groupBy("create_date", "create_hour").agg(
        F.sum("amount").cast("decimal(28,2)").alias("gmv"), F.sum("sign").cast("bigint").alias("orders")
    )


def value_table(spark, path: str) -> KeyedTable:
    """Order value by day and hour, stored by month; hours whose orders are all gone have a count of 0."""
    return KeyedTable(spark, path, _VALUE, ["create_date", "create_hour"], day_column="create_date", part_length=7)


def current_value(table: KeyedTable) -> DataFrame:
    """Hours that have orders."""
    return table.read().where(F.col("orders") > 0).withColumn("gmv", F.col("gmv").cast("double"))
