"""Document-index scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def hits(index: str, documents: DataFrame, id_column: str = "_id") -> DataFrame:
    """Documents as typed hits: ``_index``, ``_type``, ``_id`` and the document under ``_source``."""
    source: Sequence[str] = [c for c in documents.columns if c != id_column]
    return documents.select(
        F.lit(index).alias("_index"),
        F.lit("_doc").alias("_type"),
        F.col(id_column).alias("_id"),
        F.struct(*source).alias("_source"),
    )
