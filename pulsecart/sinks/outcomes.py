"""Bulk writes that tell the outcome of every item: stored, or refused with a reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from pulsecart.operators.keyed import last_by, with_generated_ids
from pulsecart.sinks.keyed_table import KeyedTable
from pulsecart.workspace import materialise

# Fixed value: longest document id, in bytes.
LONGEST_ID = 512
REASON = "_reason"
CREATED, UPDATED, REPLACED, REJECTED = "created", "updated", "replaced", "rejected"


def rules_for(schema: T.StructType, id_column: str, required: Sequence[str] = ()) -> dict[str, Column]:
    """What makes a row of texts unfit for typed columns: reason and condition, in order of precedence."""
    rules = {f"{id_column} too long": F.octet_length(F.col(id_column).cast("string")) > LONGEST_ID}
    for name in required:
        rules[f"{name} missing"] = F.col(name).isNull()
    for f in schema:
        if not isinstance(f.dataType, T.StringType):
            rules[f"{f.name} malformed"] = F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()
    return rules


def judged(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Append the reason for which a row is refused: the first rule that it breaks, else null."""
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()], F.lit(None).cast("string"))
    return rows.withColumn(REASON, reason)


def write_items(
    table: KeyedTable, rows: DataFrame, writer: str, batch_id: int,
    order: Sequence[str] = (), required: Sequence[str] = (), refused: str | None = None,
) -> DataFrame:
    """Upsert the fit rows of a batch and tell what became of each item.

    Returns the counts by ``outcome`` and ``reason``: ``created`` (a new key), ``updated`` (a known one),
    ``replaced`` (a later row of the batch has the key) and ``rejected``. The batch is judged once and
    written to the shared folder, so the counts are those of what was stored. Refused rows go, as they
    came and with their reason, to ``refused`` (default: beside the table), one folder for each batch, which
    a repeated batch writes anew. A batch that was published before is not stored again; its items then
    count as updates.
    """
    key = table.keys[0]
    own = materialise(judged(rows, rules_for(table.schema, key, required)), "judged")
    folder = f"{refused or table.path + '/refused'}/{writer}/{batch_id:012d}"
    unfit = own.where(F.col(REASON).isNotNull())
    unfit.write.mode("overwrite").parquet(folder)
    fit = own.where(F.col(REASON).isNull()).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema])
    if isinstance(table.schema[key].dataType, T.StringType):
        fit = with_generated_ids(fit, key, writer, str(batch_id))
    keys = table.row_keys()
    last = materialise(last_by(fit, keys, order), "items")
    days = [r[0] for r in last.select(table.day_column).distinct().collect()] if table.day_column else None
    known = table.written_keys(days).distinct().withColumn("_known", F.lit(True))
    same = [last[k].eqNullSafe(known[k]) for k in keys]
    outcome = F.when(F.col("_known"), F.lit(UPDATED)).otherwise(CREATED)
    stored = materialise(
        last.join(known, same, "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("items")), "outcomes"
    )  # before the write, which makes all keys known
    table.write(last, writer, batch_id, order, unique=True)
    counted = own.where(F.col(REASON).isNull()).agg(F.count("*").alias("items"))
    replaced = counted.unionByName(stored.select((-F.col("items")).alias("items"))).agg(F.sum("items").alias("items")).select(
        F.lit(REPLACED).alias("outcome"), F.lit(None).cast("string").alias("reason"), "items"
    )
    rejected = unfit.groupBy(F.lit(REJECTED).alias("outcome"), F.col(REASON).alias("reason")).agg(F.count("*").alias("items"))
    return (
        stored.select("outcome", F.lit(None).cast("string").alias("reason"), "items")
        .unionByName(replaced.where("items > 0")).unionByName(rejected)
    )
