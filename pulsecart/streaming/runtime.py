"""Starting streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from pulsecart.session import with_settings
from pulsecart.workspace import run_folder

# Fixed value: micro-batch interval.
TRIGGER = "5 seconds"


# Setting of a stream with much state: its rows are not counted at every change, which would look each of them up.
UNCOUNTED = {"spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}
# Settings of a stream whose rows all come with the batch of their input: inner joins, and aggregates in update mode.
# Old state goes with the next batch that has rows, not with a batch of its own, and is not counted at every change.
ROWS_AT_ONCE = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    **UNCOUNTED,
}


def start(
    writer: DataStreamWriter,
    checkpoint: str,
    trigger: str | None = TRIGGER,
    settings: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """Start a stream whose progress and state live in ``checkpoint``, with settings of its own if any are given.

    With ``trigger=None`` it takes what is there and stops.
    """
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    with with_settings(SparkSession.active(), settings or {}):
        return writer.start()


def drain(
    writer: DataStreamWriter, checkpoint: str, settings: Mapping[str, str] | None = None
) -> StreamingQuery:
    """Run a stream over all available data and wait for its end."""
    query = start(writer, checkpoint, trigger=None, settings=settings)
    query.awaitTermination()
    return query


def drain_to_files(df: DataFrame, label: str, settings: Mapping[str, str] | None = None) -> DataFrame:
    """Run an append-mode stream over all available data into files and read them."""
    spark = df.sparkSession
    folder = run_folder(spark, label)
    writer = df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
    drain(writer, f"{folder}/checkpoint", settings)
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")
