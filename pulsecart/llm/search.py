"""Exact top-k search by inner product with multi-resolution segment statistics.

Components become integers (``floor(scale * x)``). A vector is cut into segments; the mean and the
deviation of each bound every inner product with it: over a segment of n components, x.y is at most
n * (mean_x * mean_y + deviation_x * deviation_y). In distances this is the usual lower bound, since
|x - y|^2 = |x|^2 + |y|^2 - 2 x.y. Bounds are taken with few segments first, then with more, and a
candidate whose bound is below the k-th score found so far is out. Exact scores are computed for the
survivors. The k-th score is kept for each query and partition, so no result depends on luck.

Queries go to the tasks in blocks of ``BLOCK`` vectors, whose size bounds what is sent; candidates
stay where they were read, each block takes one pass over them, and k rows for each query and
partition are merged.

Edge cases: vectors that are null, empty, or hold a null or a component that is not finite take no
part. Vectors of different length are compared over their common components, as if padded by zeros.
Ties go to the smaller id. Rows with a repeated id are separate candidates, but none is a
candidate for its own id, and the smallest of their vectors is the query.
Null ids take no part. Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsecart.workspace import run_folder

BLOCK = 4096
LEVELS = (4, 16)
_CHUNK = 1024
_NONE = -(1 << 62)
_SLACK = 1e-6


def integers(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    good = (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, row in enumerate(rows):
        out[i, : min(width, len(row))] = row[:width]
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a dot product of two rows is the bound."""
    parts = np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1]))
    cols = []
    for part in parts:
        own = x[:, part].astype(np.float64)
        cols += [own.mean(axis=1) * np.sqrt(len(part)), own.std(axis=1) * np.sqrt(len(part))]
    return np.stack(cols, axis=1)


def best_of(
    query_ids: np.ndarray, queries: np.ndarray, batches: Iterator[tuple[np.ndarray, np.ndarray]], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, candidate id and score of the k best candidates of each query, ties to smaller ids."""
    n = len(query_ids)
    ids = np.full((n, k), np.iinfo(np.int64).max)
    scores = np.full((n, k), _NONE, dtype=np.int64)
    coarse = [statistics(queries, s) for s in LEVELS]
    for vec_ids, vectors in batches:
        for at in range(0, len(vec_ids), _CHUNK):
            own, x = vec_ids[at : at + _CHUNK], vectors[at : at + _CHUNK]
            floor = scores[:, -1].astype(np.float64)
            bound = coarse[0] @ statistics(x, LEVELS[0]).T
            q, c = np.nonzero(bound * (1 + np.sign(bound) * _SLACK) + 1 >= floor[:, None])
            for level, segments in zip(coarse[1:], LEVELS[1:]):
                fine = statistics(x, segments)
                keep = []
                for lo in range(0, len(q), 1 << 18):
                    a, b = q[lo : lo + (1 << 18)], c[lo : lo + (1 << 18)]
                    bound = np.einsum("ij,ij->i", level[a], fine[b])
                    keep.append(bound * (1 + np.sign(bound) * _SLACK) + 1 >= floor[a])
                keep = np.concatenate(keep) if keep else np.zeros(0, dtype=bool)
                q, c = q[keep], c[keep]
            other = query_ids[q] != own[c]
            q, c = q[other], c[other]
            exact = np.concatenate(
                [np.einsum("ij,ij->i", queries[q[lo : lo + (1 << 17)]], x[c[lo : lo + (1 << 17)]]) for lo in range(0, len(q), 1 << 17)]
                or [np.zeros(0, dtype=np.int64)]
            )
            better = exact >= scores[q, -1]
            q, c, exact = q[better], c[better], exact[better]
            if not len(q):
                continue
            touched = np.unique(q)
            all_q = np.concatenate([np.repeat(touched, k), q])
            all_id = np.concatenate([ids[touched].ravel(), own[c]])
            all_score = np.concatenate([scores[touched].ravel(), exact])
            order = np.lexsort((all_id, -all_score, all_q))
            all_q, all_id, all_score = all_q[order], all_id[order], all_score[order]
            first = np.searchsorted(all_q, touched)
            take = first[:, None] + np.arange(k)
            ids[touched], scores[touched] = all_id[take], all_score[take]
    found = scores > _NONE
    return np.nonzero(found)[0], ids[found], scores[found]


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """The k best of all other rows for each row where ``is_query`` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = (
        vectors.where(F.col(key).isNotNull())
        .select(F.col(key).cast("bigint").alias("_id"), integers(F.col(vector), scale).alias("_x"), is_query.alias("_query"))
        .where(F.col("_x").isNotNull())
    )
    asked = rows.where("_query").select("_id", "_x")
    n = asked.count()
    blocks = max(1, -(-n // (BLOCK // 2)))
    part = F.pmod(F.xxhash64("_id"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    path = run_folder(spark, "top-k")
    schema = "_q bigint, _id bigint, _score bigint"
    for b in range(blocks):
        rows_of = sorted((r["_id"], r["_x"]) for r in asked.where(part == b).collect()) if n else []
        block = list({i: (i, x) for i, x in reversed(rows_of)}.values())
        width = max((len(x) for _, x in block), default=1)
        shared = spark.sparkContext.broadcast(
            (np.array([i for i, _ in block], dtype=np.int64), _matrix([x for _, x in block], width))
        )

        def search(batches: Iterator[pd.DataFrame], shared=shared, width=width) -> Iterator[pd.DataFrame]:
            query_ids, queries = shared.value
            if not len(query_ids):
                return
            found = ((t["_id"].to_numpy(), _matrix(t["_x"].tolist(), width)) for t in batches)
            q, ids, scores = best_of(query_ids, queries, found, k)
            yield pd.DataFrame({"_q": query_ids[q], "_id": ids, "_score": scores})

        rows.select("_id", "_x").mapInPandas(search, schema).write.mode("append").parquet(path)
    order = Window.partitionBy("_q").orderBy(F.desc("_score"), "_id")
    return (
        spark.read.schema(schema).parquet(path)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(F.col("_q").alias("query_id"), "rank", F.col("_id").alias("vec_id"), F.col("_score").alias("score"))
    )
