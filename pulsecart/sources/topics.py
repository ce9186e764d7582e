"""Topics of JSON texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_STORED = "value string, ingest_time timestamp, topic string"


def _of_topic(rows: DataFrame, topic: str) -> DataFrame:
    """Only this topic's folder is read. The root is named, not the folder, as the log of committed
    files lies in the root: files that a failed batch has left are not in it."""
    return rows.filter(F.col("topic") == topic).select("value", "ingest_time")


def read_kafka_topic(
    spark: SparkSession, brokers: str, topic: str, starting: str = "latest", **options: str
) -> DataFrame:
    """A broker topic as a stream of ``value`` and ``ingest_time``.

    Needs the Kafka connector of the same Spark version on the class path. Offsets live in the
    query's checkpoint; ``starting`` counts only for a checkpoint that is new.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load().select(
        F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ingest_time")
    )


def stream_topic(
    spark: SparkSession, root: str, topic: str, files_per_trigger: int | None = None
) -> DataFrame:
    """A topic that :func:`pulsecart.sinks.topics.write_topics` keeps as files, as a stream."""
    reader = spark.readStream.schema(_STORED)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _of_topic(reader.parquet(root), topic)


def read_topic(spark: SparkSession, root: str, topic: str) -> DataFrame:
    """The same topic as a batch."""
    return _of_topic(spark.read.schema(_STORED).parquet(root), topic)
