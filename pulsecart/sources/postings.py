"""An inverted index: which documents hold a token, kept up to date by upserts of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsecart.functions import tokens
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.workspace import materialise

BUCKETS = 32
_POSTING = "token string, id string, gone boolean, bucket string"
_ENTRY = "id string, tokens array<string>, bucket string"


class Postings:
    """Postings of one text field, by buckets of a hash of the token.

    A search reads the buckets of the tokens it asks for and no others, with the tokens pushed down to their
    files. The tokens of each document are stored besides, by buckets of its id, so that an upsert knows
    which tokens a document has lost; those postings are marked as gone. A token that is in very many
    documents is one posting for each of them, so its bucket is split over tasks by file, as in any scan.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.postings = KeyedTable(spark, f"{path}/postings", _POSTING, ["token", "id"], day_column="bucket")
        self.entries = KeyedTable(spark, f"{path}/entries", _ENTRY, ["id"], day_column="bucket")

    def _bucket(self, value: Column) -> Column:
        return F.lpad(F.pmod(F.xxhash64(value), F.lit(self.buckets)).cast("string"), 5, "0")

    def upsert(self, documents: DataFrame, text: str, writer: str, batch_id: int, id_column: str = "_id") -> None:
        """Put a batch of documents, one row for each id, in place of what was known of them.

        A null text has no tokens, so it takes the document out of the index. A batch that is sent again
        changes nothing: postings are written first, and both tables skip a batch that they hold.
        """
        own = documents.where(F.col(id_column).isNotNull()).select(
            F.col(id_column).cast("string").alias("id"),
            F.array_sort(F.array_distinct(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")))).alias("tokens"),
        )
        own = materialise(own.withColumn("bucket", self._bucket(F.col("id"))), "entries")
        touched = [r["bucket"] for r in own.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        before = self.entries.read(touched, ["id", "tokens"]).withColumnRenamed("tokens", "before")
        both = own.join(before, "id", "left")
        lost = F.transform(F.array_except("before", "tokens"), lambda t: F.struct(t.alias("token"), F.lit(True).alias("gone")))
        held = F.transform(F.array_except("tokens", F.coalesce("before", F.array().cast("array<string>"))),
                           lambda t: F.struct(t.alias("token"), F.lit(False).alias("gone")))
        changed = both.select("id", F.explode(F.concat(F.coalesce(lost, F.array().cast("array<struct<token:string,gone:boolean>>")), held)).alias("p"))
        changed = changed.select("p.token", "id", "p.gone", self._bucket(F.col("p.token")).alias("bucket"))
        self.postings.write(changed, writer, batch_id, unique=True)
        self.entries.write(own, writer, batch_id, unique=True)

    def any_of(self, wanted: str) -> DataFrame:
        """Ids of the documents that hold a token of the wanted text; none for a text without tokens."""
        query = self.spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(wanted)))).alias("token"))
        rows = query.select("token", self._bucket(F.col("token")).alias("bucket")).collect()  # tokens of the query
        found = self.postings.read(sorted({r["bucket"] for r in rows}), ["token", "id", "gone"])
        return found.where(F.col("token").isin([r["token"] for r in rows]) & ~F.col("gone")).select("id").distinct()

    def matching(self, documents: DataFrame, wanted: str, id_column: str = "_id") -> DataFrame:
        """The documents themselves."""
        ids = self.any_of(wanted)
        return documents.join(ids, documents[id_column] == ids["id"], "left_semi")
