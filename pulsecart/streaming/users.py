"""Latest user records from a stream of changes."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pulsecart.schemas import USER_INFO
from pulsecart.sinks.keyed_table import KeyedTable


def user_table(spark: SparkSession, path: str, schema: str = USER_INFO) -> KeyedTable:
    """The user snapshot: the last record of each id.

    Feed it with ``writeStream.foreachBatch(table.upsert_batches(writer, order))``.
    """
    return KeyedTable(spark, path, schema, ["id"])
