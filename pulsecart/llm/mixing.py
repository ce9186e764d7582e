"""Mix sources to target weights by systematic sampling, in DataFrame functions only.

A document's size is its number of words. Every source gets a target: its share, by weight, of ``share``
times all words, at most ``most`` times its own; what it cannot take goes to the others by weight.
Every document of a source has the same expected number of copies, target by size of the source.

Systematic sampling: the documents of a source stand in order of size, the expected copies are summed
along it, one random offset of the source is added, and a document is emitted once for each integer
boundary that its part of the sum crosses. So a document has the whole part of its expected copies, or
one more, and as neighbours are of like size, the words taken differ from the target by less than the
longest document of the source for each copy. Sums are exact: copies are in units of 2**-40.

The place of a document in its source needs no sort of a whole source. Documents are counted by source,
size and, where more than ``CELL`` are of one size, by the leading digits of a digest of the key. Counts
are summed over the digests of a size, then over the sizes of a source; single documents are numbered
inside their cell only. Of all the tasks none gets more than a cell, the cells of one size, or the
distinct sizes of one source.

Edge cases: a null or empty text, or one of white space, has size 0; its copies count no words. Null is
a source of its own and the last. A table without words has targets of 0 and takes nothing. Repeated
rows are documents each. The order is by size, digest of the key and key; null keys stand first; rows
with the same key and size are equal, so it does not matter which of them is taken. Other columns are not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecart.workspace import materialise

CELL = 100_000
UNITS = 1 << 40  # one copy
WEIGHTS = (5, 2, 1)
_BLANKS = "\t\n\x0b\x0c\r "


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space: each becomes one character."""
    inside = F.ltrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.length(F.regexp_replace(inside, F.lit(r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"), F.lit("x"))).cast("bigint")


def targets(
    sources: DataFrame, weight: Column, share: tuple[int, int] = (3, 2), most: int = 2, size: str = "source_size"
) -> DataFrame:
    """Append the target of each source to a table of one row per source.

    ``share`` (numerator, denominator) of all words is dealt by weight, at most ``most`` times each size. In
    order of size by weight the capped sources come first, so sums along that order say which are.
    """
    rows = sources.withColumn("_weight", weight.cast("bigint")).withColumn("_cap", F.col(size) * most)
    order = Window.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_cap"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("_all", F.sum(size).over(everything))
        .withColumn("_before", F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_ahead", F.sum("_weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    )
    wide = "decimal(38,0)"
    left = F.col("_all").cast(wide) * share[0] - F.coalesce("_before", F.lit(0)).cast(wide) * share[1]
    capped = left.cast(wide) * F.col("_weight") >= (F.col("_cap").cast(wide) * share[1]).cast(wide) * F.col("_ahead")
    rows = rows.withColumn("_capped", capped)
    taken = F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_weight"))).over(everything)
    dealt = F.try_divide((F.col("_all") * share[0] - taken * share[1]).cast("double") * F.col("_weight"), free * share[1])
    target = F.when(F.col("_capped"), F.col("_cap").cast("double")).otherwise(dealt)
    return rows.withColumn("target", target).drop("_weight", "_cap", "_all", "_before", "_ahead", "_capped")


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in units: 40 bits of a digest."""
    named = F.concat(F.lit(f"{seed}:"), F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 10), 16, 10).cast("bigint")


def sample(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 42,
    key: str = "doc_id", text: str = "text", source: str = "source", cell: int = CELL,
) -> DataFrame:
    """One row per document: key, source, size, source_size, target (of the source) and copies.

    Sources, by code point and null last, have the weights in turn.
    """
    docs = materialise(
        documents.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size")),
        "sizes",
    )
    by_size = materialise(docs.groupBy("source", "size").agg(F.count("*").alias("rows")), "rows-by-size")
    sums = by_size.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).cast("bigint").alias("source_size"), F.sum("rows").alias("source_rows")
    )
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("turn") + 1).cast("int"))
    sources = targets(sums.withColumn("turn", turn), weight, share, most).select(
        "source", "source_size", "target",
        F.coalesce(F.floor(F.try_divide("target", "source_size") * UNITS), F.lit(0)).cast("bigint").alias("expected"),
        offset(F.col("source"), seed).alias("offset"),
    )
    sources = materialise(sources, "sources")

    # Sizes of many documents are divided by the digits of a digest, so that a cell has about CELL rows.
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("rows") / cell))).cast("int")
    parts = by_size.select(F.col("source").alias("_source"), F.col("size").alias("_size"), digits.alias("digits")).where("digits > 0")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    digest = F.coalesce(F.md5(F.col("key").cast("string").cast("binary")), F.lit(""))
    dealt = docs.join(parts, same, "left").select(
        "key", "source", "size", digest.alias("digest"), F.substring(digest, F.lit(1), F.coalesce("digits", F.lit(0))).alias("part")
    )
    in_size = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    smaller = by_size.select(
        F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.coalesce(F.sum("rows").over(in_source), F.lit(0)).alias("smaller"),
    )
    named = F.col("_source").eqNullSafe(F.col("named"))
    smaller = smaller.join(sources.withColumnRenamed("source", "named"), named).drop("named")
    cells = (
        dealt.groupBy("source", "size", "part").agg(F.count("*").alias("rows"))
        .withColumn("ahead", F.coalesce(F.sum("rows").over(in_size), F.lit(0)))
        .join(smaller, same)
        .select(
            F.col("_source").alias("in_source"), F.col("_size").alias("in_size"), F.col("part").alias("in_part"),
            (F.col("ahead") + F.col("smaller")).alias("before"), "source_size", "target", "expected", "offset",
        )
    )
    own = (
        F.col("source").eqNullSafe(F.col("in_source")) & (F.col("size") == F.col("in_size")) & (F.col("part") == F.col("in_part"))
    )
    number = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("digest", "key"))
    placed = dealt.withColumn("number", number).join(cells, own).withColumn("rank", F.col("before") + F.col("number"))

    def crossed(rank: Column) -> Column:
        total = rank.cast("decimal(18,0)") * F.col("expected").cast("decimal(15,0)") + F.col("offset").cast("decimal(15,0)")
        return F.call_function("div", total, F.lit(UNITS).cast("decimal(14,0)"))

    copies = crossed(F.col("rank")) - crossed(F.col("rank") - 1)
    return placed.select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", copies.cast("bigint").alias("copies")
    )


def emit(documents: DataFrame, sampled: DataFrame, key: str = "doc_id", out: str = "copy") -> DataFrame:
    """The mix itself: every document as often as it was taken, with the number of the copy from 1. Keys must be unique."""
    own = sampled.where("copies > 0").select(F.col(key).alias("_key"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(out))
    return documents.join(own, documents[key] == own["_key"]).drop("_key")
