"""Routing of change records to topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsecart.functions import after_image_json
from pulsecart.sources.changes import row_changes

ORDER_TOPIC = "order_info"
DETAIL_TOPIC = "order_detail"
USER_TOPIC = "user_info"

# Which changes of which table go to which topic.
ROUTES = [
    ("order_info", ["INSERT"], ORDER_TOPIC),
    ("order_detail", ["INSERT"], DETAIL_TOPIC),
    ("user_info", ["INSERT", "UPDATE"], USER_TOPIC),
]


def routed(records: DataFrame, routes=ROUTES) -> DataFrame:
    """Row changes that have a topic, with ``topic`` and their ``after`` columns."""
    topic = F.lit(None).cast("string")
    for table, events, name in reversed(routes):
        takes = (F.col("table") == table) & F.col("event_type").isin(*events)
        topic = F.when(takes, F.lit(name)).otherwise(topic)
    rows = row_changes(records).withColumn("topic", topic)
    return rows.filter(F.col("topic").isNotNull()).select("topic", "after")


def as_messages(rows: DataFrame) -> DataFrame:
    """Routed rows as ``topic`` and JSON ``value``."""
    return rows.select("topic", after_image_json("after").alias("value"))
