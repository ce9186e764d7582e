"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: some texts are very long, and a batch is held in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of one table of the folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def pieces(text: Column, size: int, most: int) -> Column:
    """At most ``most`` pieces of ``size`` characters, spread evenly over the whole text.

    Bounds what one labelled row brings to the training of a model.
    """
    return F.when(F.length(text) <= size * most, F.array(text)).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.lit(most - 1)),
            lambda i: F.substring(
                text,
                (F.floor(i * ((F.length(text) - size) / (most - 1))) + 1).cast("int"),
                F.lit(size),
            ),
        )
    )


def balanced_sample(rows: DataFrame, label: str, key: str, cap: int, most_labels: int = 1000) -> DataFrame:
    """About ``cap`` rows of each label, chosen by a hash of the key, so the same rows every time.

    Every label takes part. With more than ``most_labels`` of them, each brings fewer rows, but 20 at
    least. Only the label counts reach the driver. A label with fewer rows keeps them all.
    """
    counts = (
        rows.where(F.col(label).isNotNull()).groupBy(label).count()
        .orderBy(F.desc("count"), label).collect()
    )
    if not counts:
        return rows.where(F.lit(False))
    if len(counts) > most_labels:
        cap = min(cap, max(20, cap * most_labels // len(counts)))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[label], min(1.0, cap / r["count"]))])
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(F.col(label).isNotNull() & (draw < F.element_at(share, F.col(label))))


def seed_of(*parts) -> int:
    """A stable 63-bit number from any parts."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "little") >> 1


def log_odds_of(p: float) -> float:
    return math.log(p / (1 - p))
