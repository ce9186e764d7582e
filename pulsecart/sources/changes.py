"""Change-record scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def row_changes(records: DataFrame) -> DataFrame:
    """One row per changed row: ``table``, ``event_type`` and the ``after`` columns.

    Entries that carry no row data, such as transaction marks, are left out.
    """
    return records.filter(F.col("entry_type") == "ROWDATA").select(
        "table", "event_type", F.explode("rows").alias("after")
    )
