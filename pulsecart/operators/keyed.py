"""Keyed upsert: the last change of each key wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first by ``order``.

    One aggregate with map-side partials: a hot key shrinks to one row per input partition before
    the shuffle. Ties beyond ``order`` are broken by the remaining columns, so the result does not
    depend on the order of the rows.
    """
    return _extreme(df, keys, order, F.min)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes last by ``order``; see :func:`first_by`."""
    return _extreme(df, keys, order, F.max)


def _extreme(df, keys, order, pick) -> DataFrame:
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not order and not rest:
        return df.distinct()
    row = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_row"))
    columns = [F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns]
    return row.select(*columns)


def with_generated_ids(df: DataFrame, id_column: str, *source: str) -> DataFrame:
    """Give rows without an id a generated one, so that none of them replaces another.

    The id is a digest of ``source`` (such as the writer and its batch), the row, and a number among
    equal rows. So a batch that is computed again gives its rows the same ids.
    """
    content = F.sha2(F.concat_ws("|", *[F.lit(x) for x in source], F.to_json(F.struct("*"))), 256)
    alone = df.filter(F.col(id_column).isNull()).withColumn("_content", content)
    number = F.row_number().over(Window.partitionBy("_content").orderBy("_content"))
    named = alone.withColumn(id_column, F.concat_ws("-", "_content", number.cast("string")))
    return df.filter(F.col(id_column).isNotNull()).unionByName(named.drop("_content"))


def last_with_ids(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], id_column: str, *source: str
) -> DataFrame:
    """:func:`last_by` after :func:`with_generated_ids`, with the same ids, from one pass over the rows.

    The rows of a micro-batch are computed anew for every read of them, state and all, so they are read once.
    """
    keys, order = list(keys), list(order)
    content = F.sha2(F.concat_ws("|", *[F.lit(x) for x in source], F.to_json(F.struct("*"))), 256)
    alone = F.when(F.col(id_column).isNull(), content)
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = [F.max(F.struct(*order, *rest)).alias("_row")] if order or rest else []
    last = df.withColumn("_content", alone).groupBy(*keys, "_content").agg(*row, F.count("*").alias("_n"))
    number = F.sequence(F.lit(1).cast("bigint"), F.when(F.col("_content").isNull(), F.lit(1)).otherwise(F.col("_n")))
    named = F.coalesce(id_column, F.concat_ws("-", "_content", F.col("_number").cast("string")))
    columns = [F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns]
    return last.withColumn("_number", F.explode(number)).withColumn(id_column, named).select(*columns)


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` put in by key; ``changes`` has one row per key.

    Rows of ``base`` are not shuffled when the changes are small enough to be broadcast, which
    Spark decides from their size.
    """
    kept = base.join(changes.select(*keys), list(keys), "left_anti")
    return kept.select(*base.columns).unionByName(changes.select(*base.columns))
