"""Change records on a stream: route them to topics, and read topics as records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from pulsecart.functions import parse_records, split_corrupt
from pulsecart.operators.routing import as_messages, routed
from pulsecart.sinks.topics import topics_writer


def routing_writer(records: DataFrame, root: str) -> DataStreamWriter:
    """Route a stream of change records into topic folders below ``root``."""
    return topics_writer(as_messages(routed(records)), root)


def records_of(topic: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Typed records of a topic stream, with ``ingest_time``, and the texts of the broken ones."""
    return split_corrupt(parse_records(topic, schema))
