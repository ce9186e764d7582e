"""The join by arrival of :mod:`pulsecart.streaming.arrivals`, batch by batch with window functions.

The rules and results are the same. State is what is remembered, as files that each batch reads and writes
anew, in place of a store that Python asks key by key. That costs a pass over all that is remembered for
each batch, and far less for each order that a batch brings.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsecart.functions import seconds_in
from pulsecart.schemas import JOIN_TOLERANCE
from pulsecart.streaming.arrivals import _ORDER_FIELDS

_ORDER, _DETAIL = 0, 1


def arrivals_of(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Both sides as one stream of rows; those without an order id or a time are left out."""
    names = [c for c in details.columns if c not in ("order_id", "ingest_time")]

    def side(rows: DataFrame, number: int, key: str) -> DataFrame:
        order = F.struct(*_ORDER_FIELDS) if number == _ORDER else F.lit(None).cast(orders.select(F.struct(*_ORDER_FIELDS)).schema[0].dataType)
        detail = F.struct(*names) if number == _DETAIL else F.lit(None).cast(details.select(F.struct(*names)).schema[0].dataType)
        known = rows.where(F.col(key).isNotNull() & F.col("ingest_time").isNotNull())
        return known.select(
            F.col(key).cast("string").alias("order_id"), F.lit(number).alias("side"),
            F.unix_micros("ingest_time").alias("arrived"), order.alias("o"), detail.alias("d"),
        )

    return side(orders, _ORDER, "id").unionByName(side(details, _DETAIL, "order_id"))


def _marked(rows: DataFrame, keep: int) -> DataFrame:
    """Rows with the delivery that a detail meets, and the number of the waiting set that each row is in or finds."""
    in_order = Window.partitionBy("order_id").orderBy("at", "arrived", "side")
    upto = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    is_order = F.col("side") == _ORDER
    last_order = F.last(F.when(is_order, F.struct("at", "arrived", "o")), ignorenulls=True).over(upto)
    rows = rows.withColumn("delivery", last_order)
    met = F.coalesce(F.col("at") - F.col("delivery.at") < keep, F.lit(False)) & ~is_order
    rows = rows.withColumn("met", met).withColumn("waits", ~is_order & ~F.col("met"))
    refreshed = F.when(F.col("waits"), F.coalesce("refreshed", "at"))
    rows = rows.withColumn("refreshed", refreshed)
    rows = rows.withColumn("since", F.max("refreshed").over(before))
    alive = F.coalesce(F.col("at") - F.col("since") < keep, F.lit(False))
    rows = rows.withColumn("alive", alive)
    return rows.withColumn("set", F.sum((F.col("waits") & ~F.col("alive")).cast("bigint")).over(upto))


def _waiting(marked: DataFrame) -> DataFrame:
    """Details by waiting set; one that was delivered twice waits once, and the set is refreshed all the same."""
    own = marked.where("waits").groupBy("order_id", "set", "d").agg(
        F.min(F.struct("at", "arrived")).alias("first"), F.max("refreshed").alias("refreshed")
    )
    return own.select("order_id", "set", "d", "first.at", "first.arrived", "refreshed")


def _pairs(marked: DataFrame) -> DataFrame:
    """Pairs that the new rows bring about."""
    new = marked.where("new")
    met = new.where("met").select("order_id", F.col("delivery.o").alias("o"), F.col("delivery.arrived").alias("o_arrived"), "d", "arrived")
    orders = new.where((F.col("side") == _ORDER) & F.col("alive")).select(
        "order_id", "set", "o", F.col("at").alias("o_at"), F.col("arrived").alias("o_arrived")
    )
    found = orders.join(_waiting(marked), ["order_id", "set"]).where(F.struct("at", "arrived") < F.struct("o_at", "o_arrived"))
    return met.unionByName(found.select("order_id", "o", "o_arrived", "d", "arrived"))


def _remembered(marked: DataFrame, keep: int, reached: int) -> DataFrame:
    """The last delivery of each order and its last waiting set, if the clock may still need them."""
    def row(side: int, **own: Column):
        kinds = {"at": "bigint", "arrived": "bigint", "refreshed": "bigint", "o": marked.schema["o"].dataType, "d": marked.schema["d"].dataType}
        return [F.col("order_id"), F.lit(side).alias("side"), *[own.get(c, F.lit(None).cast(t)).alias(c) for c, t in kinds.items()]]

    orders = marked.where(F.col("side") == _ORDER).groupBy("order_id").agg(F.max_by(F.struct("at", "arrived", "o"), F.struct("at", "arrived")).alias("last"))
    orders = orders.select(*row(_ORDER, at=F.col("last.at"), arrived=F.col("last.arrived"), o=F.col("last.o")))
    sets = _waiting(marked)
    last = sets.groupBy("order_id").agg(F.max("set").alias("set"), F.max("refreshed").alias("until"))
    last = sets.drop("refreshed").join(last, ["order_id", "set"])
    waiting = last.select(*row(_DETAIL, at=F.col("at"), arrived=F.col("arrived"), refreshed=F.col("until"), d=F.col("d")))
    return orders.unionByName(waiting).where(F.coalesce("refreshed", "at") + keep > reached)


def arrival_sink(
    folder: str,
    write: Callable[[DataFrame, int], None],
    keep: str = JOIN_TOLERANCE,
    clock: str = "processing",
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for rows of :func:`arrivals_of`; ``write`` gets the pairs of each batch.

    State lies below ``folder``, a version for each batch. A batch that is repeated reads the version before
    it once more and replaces its own, so ``write`` has to replace what it wrote under that batch number, too.
    ``clock`` is as for the other form. With ``transport``, state leaves a lifetime later than it ends, as the
    rows of a batch may be that much older than the newest one. Rows of one order are sorted in one task, which
    spills; they are not gathered to a list.
    """
    if clock not in ("processing", "transport"):
        raise ValueError("clock must be processing or transport")
    life = seconds_in(keep) * 1_000_000

    def version(batch_id: int) -> str:
        return f"{folder}/state/{batch_id}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        now = int(time.time() * 1_000_000)
        at = F.lit(now) if clock == "processing" else F.col("arrived")
        rows = batch.withColumn("at", at).withColumn("refreshed", F.lit(None).cast("bigint")).withColumn("new", F.lit(True))
        if batch_id > 0:
            held = own.read.schema(rows.drop("new").schema).parquet(version(batch_id - 1))
            rows = rows.unionByName(held.withColumn("new", F.lit(False)))
        marked = _marked(rows, life).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            newest = marked.agg(F.max("at")).first()[0]
            reached = now if clock == "processing" else (newest or 0) - life
            write(_wide(_pairs(marked)), batch_id)
            _remembered(marked, life, reached).write.mode("overwrite").parquet(version(batch_id))
        finally:
            marked.unpersist()
        path = own._jvm.org.apache.hadoop.fs.Path(version(batch_id - 2))
        path.getFileSystem(own._jsc.hadoopConfiguration()).delete(path, True)  # no batch can be repeated from it

    return sink


def _wide(pairs: DataFrame) -> DataFrame:
    names = pairs.schema["d"].dataType.names
    return pairs.select(
        F.col("order_id").alias("o_id"), *[F.col(f"o.{c}").alias(f"o_{c}") for c in _ORDER_FIELDS],
        F.timestamp_micros("o_arrived").alias("o_ingest_time"), *[F.col(f"d.{c}").alias(f"d_{c}") for c in names],
        F.col("order_id").alias("d_order_id"), F.timestamp_micros("arrived").alias("d_ingest_time"),
    )
