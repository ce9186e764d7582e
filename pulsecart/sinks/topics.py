"""Topics of JSON texts, kept as files or sent to brokers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter


def _message(messages: DataFrame) -> DataFrame:
    known = F.col("ingest_time") if "ingest_time" in messages.columns else F.current_timestamp()
    return messages.select("topic", "value", known.alias("ingest_time"))


def write_topics(messages: DataFrame, root: str) -> None:
    """Append ``topic`` and ``value`` rows to one folder per topic."""
    _message(messages).write.mode("append").partitionBy("topic").parquet(root)


def topics_writer(messages: DataFrame, root: str) -> DataStreamWriter:
    """The same for a stream; each file shows up once its batch is committed."""
    return (
        _message(messages).writeStream.format("parquet")
        .outputMode("append").partitionBy("topic").option("path", root)
    )


def kafka_writer(messages: DataFrame, brokers: str) -> DataStreamWriter:
    """Send ``topic`` and ``value`` rows to brokers; needs the Kafka connector."""
    return (
        messages.select("topic", F.col("value").cast("string").alias("value"))
        .writeStream.format("kafka").option("kafka.bootstrap.servers", brokers)
    )
