"""When each device was first active, kept up as days come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.workspace import materialise

BUCKETS = 32
_DEVICE = "mid string, day string, bucket string"
_CHANGE = "id string, logdate string, change bigint"


class FirstSeen:
    """First active day by device, in buckets of the device, and how the new devices of each day changed.

    A batch of active devices is met with the devices of its buckets, never with the days before it. Devices
    that are known with an earlier day change nothing. Days may come late: a device then moves from the
    day it was counted for to the earlier one. Counts are sums over a short ledger of changes, a row for
    each day that a batch touches.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.devices = KeyedTable(spark, f"{path}/devices", _DEVICE, ["mid"], day_column="bucket")
        self.ledger = KeyedTable(spark, f"{path}/ledger", _CHANGE, ["id"])

    def _bucket(self, value: Column) -> Column:
        return F.lpad(F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("string"), 5, "0")

    def merge(self, daily: DataFrame, writer: str, batch_id: int) -> None:
        """Take in active devices (``mid``, ``logdate``; repeats are no matter) of one or more days.

        A batch that is sent again changes nothing: the ledger is written first, and both tables skip a batch
        that they hold. Rows without a device or a day are left out.
        """
        own = daily.where(F.col("mid").isNotNull() & F.col("logdate").isNotNull())
        own = own.groupBy("mid").agg(F.min("logdate").alias("day")).withColumn("bucket", self._bucket(F.col("mid")))
        own = materialise(own, "first-seen")
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        known = self.devices.read(touched, ["mid", "day"]).withColumnRenamed("day", "before")
        earlier = own.join(known, "mid", "left").where(F.col("before").isNull() | (F.col("day") < F.col("before")))
        earlier = materialise(earlier, "first-seen-new")
        moves = F.array(F.struct(F.col("day").alias("logdate"), F.lit(1).alias("n")), F.struct(F.col("before").alias("logdate"), F.lit(-1).alias("n")))
        changes = earlier.select(F.inline(moves)).where(F.col("logdate").isNotNull())
        changes = changes.groupBy("logdate").agg(F.sum("n").alias("change")).where(F.col("change") != 0)
        named = changes.withColumn("id", F.concat_ws("-", F.lit(writer), F.lit(str(batch_id)), "logdate"))
        self.ledger.write(named, writer, batch_id, unique=True)
        self.devices.write(earlier, writer, batch_id, unique=True)

    def new_devices(self, day: str | None = None) -> DataFrame:
        """Number of devices whose first active day it is, for each day that has any, or for the day named."""
        changes = self.ledger.read(columns=["id", "logdate", "change"])
        if day is not None:
            changes = changes.where(F.col("logdate") == day)
        return changes.groupBy("logdate").agg(F.sum("change").alias("new_devices")).where(F.col("new_devices") > 0)
