"""From raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of documents; the last one returns ids in place of the text. Rows with a null id pass every
stage that does not judge their text. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsecart.llm import bpe, decontaminate, language, neardup, secrets
from pulsecart.llm.queries import vocabulary
from pulsecart.workspace import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not recognised, those without letters included."""
    model = language.fit(docs.select("doc_id", "text", "lang"))
    return language.identify(docs, model, out="_language").where(~F.col("_language.rejected")).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near-duplicates (five words, similarity 0.8)."""
    dropped = neardup.classes(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id")
    dropped = materialise(dropped, "duplicates").hint("merge")  # grows with the documents: never broadcast
    return docs.join(dropped, "doc_id", "left_anti").select(COLUMNS)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return docs.where(~decontaminate.holding(docs, items)).select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of every secret and count the characters anew where one was found."""
    found = secrets.scan(docs, out="_secrets")
    cleaned = secrets.redact(found, secrets="_secrets")
    n_chars = F.when(F.size("_secrets") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", n_chars).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed, and whether they decode to the same bytes."""
    path, pattern = vocabulary()
    ids = bpe.encode(docs, path, pattern)
    decoded = bpe.decode(ids, path, pattern)
    whole = F.coalesce(F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.lit(False))
    return decoded.select(
        "doc_id", "lang", "source", "n_chars", bpe.n_ids(F.col("ids")).alias("n_tokens"), "ids", whole.alias("round_trip")
    )


STAGES = [
    ("language", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", uncontaminated),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

# A trained model, random trees, edit distances and merges are beyond SQL; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of the folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
