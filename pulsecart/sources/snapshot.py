"""A keyed snapshot in buckets, of which a lookup reads only those that it needs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsecart.sinks.keyed_table import KeyedTable

BUCKETS = 64
_BUCKET = "_bucket"


class BucketedSnapshot:
    """The last record of each key, stored in a fixed number of buckets by a hash of the key.

    Writes are upserts, as in the keyed table below. :meth:`of_batch` reads the buckets in which the keys of a
    batch lie and no other files; :meth:`of_key` reads one bucket, with the key pushed down to its files. More
    buckets make a lookup of few keys cheaper and a write of many keys dearer; the number is fixed once
    written.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "id", buckets: int = BUCKETS):
        self.key, self.buckets = key, buckets
        columns = T.StructType.fromDDL(schema)
        self.names = columns.names
        stored = T.StructType([*columns, T.StructField(_BUCKET, T.StringType())])
        self.table = KeyedTable(spark, path, stored, [key], day_column=_BUCKET)

    def bucket_of(self, key: Column) -> Column:
        return F.lpad(F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("string"), 5, "0")

    def write(self, rows: DataFrame, writer: str, batch_id: int, order: Sequence[str] = ()) -> bool:
        """Upsert a batch; the last record of a key by ``order`` wins. Records without a key are left out."""
        keyed = rows.where(F.col(self.key).isNotNull())
        return self.table.write(keyed.withColumn(_BUCKET, self.bucket_of(F.col(self.key))), writer, batch_id, order)

    def upsert_batches(self, writer: str, order: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
        """The same as a ``foreachBatch`` function."""
        return lambda rows, batch_id: self.write(rows, writer, batch_id, order)

    def of_batch(self, batch: DataFrame, key: str) -> DataFrame:
        """Records of the buckets in which the keys of the batch lie: those of its keys are among them."""
        keys = batch.where(F.col(key).isNotNull()).select(self.bucket_of(F.col(key)).alias("bucket"))
        touched = [r["bucket"] for r in keys.distinct().collect()]  # as many as there are buckets, at most
        return self.table.read(touched, self.names)

    def of_key(self, value: str) -> DataFrame:
        """The record of one key."""
        spark = self.table.spark
        bucket = spark.range(1).select(self.bucket_of(F.lit(value))).first()[0]
        return self.table.read([bucket], self.names).where(F.col(self.key) == value)
