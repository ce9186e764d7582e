"""Previews and row counts that ride along with another output."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

PREVIEW_ROWS = 10


def console_writer(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataStreamWriter:
    """Print the first rows of every micro-batch."""
    return df.writeStream.format("console").option("numRows", rows).option("truncate", False)


def counted(df: DataFrame, name: str | Observation) -> DataFrame:
    """Count rows while they pass; no job of its own."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def observed_counts(query: StreamingQuery, name: str) -> list[int]:
    """Row counts per micro-batch of a :func:`counted` stream."""
    seen = [p.observedMetrics.get(name) for p in query.recentProgress]
    return [row["rows"] for row in seen if row is not None]
