"""Exact cosine search of a query set against all rows, in blocks of queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakelens.functions.similarity import cosine
from lakelens.runtime import written

#: Queries for each scan: their matrix is broadcast.
BLOCK = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    flat = np.asarray(lists.flatten(), np.float64)
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def similar_of_others(rows: DataFrame, asked: DataFrame, id_cols: list[str], group_col: str, vector_col: str, top_k: int = 10, least: float = 0.4) -> DataFrame:
    """(query_<ids>, <ids>, similarity, rank): for each asked row the nearest rows of other groups with cosine >= ``least``.

    The asked rows are a stated set, such as the columns of one data set against all columns of a lake; they are broadcast
    in blocks of about ``BLOCK``. Null and empty vectors, and those of another length, match nothing; ties rank by id.
    Cosines are built-in expressions, and ranks are cut before the shuffle by Spark's window limit.
    """
    q = written(asked.select(*(F.col(c).alias(f"query_{c}") for c in id_cols), F.col(group_col).alias("_g"), F.col(vector_col).cast("array<double>").alias("_q")), "similar-asked")
    blocks = max(1, -(-q.count() // BLOCK))
    every = rows.select(*id_cols, F.col(group_col).alias("_h"), F.col(vector_col).cast("array<double>").alias("_v"))
    other = (F.col("_g") != F.col("_h")) & (F.size("_q") == F.size("_v")) & (F.size("_q") > 0)
    own = lambda b: q if blocks == 1 else q.where(F.pmod(F.xxhash64(*(f"query_{c}" for c in id_cols)), F.lit(blocks)) == b)
    pairs = reduce(DataFrame.union, [every.join(F.broadcast(own(b)), other) for b in range(blocks)])
    scored = pairs.select(*(f"query_{c}" for c in id_cols), *id_cols, cosine(F.col("_q"), F.col("_v")).alias("similarity")).where(F.col("similarity") >= least)
    best = Window.partitionBy(*(f"query_{c}" for c in id_cols)).orderBy(F.desc("similarity"), *id_cols)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def nearest(rows: DataFrame, queries: DataFrame, id_col: str, vector_col: str, top_k: int = 10, least: float = 0.4, block: int = BLOCK) -> DataFrame:
    """(query_id, id, similarity, rank): for each query the ``top_k`` other rows with cosine >= ``least``.

    Null vectors, and vectors that hold nulls or are of another length than the query's, match nothing; ties rank by
    id. Every task keeps its own best, so only top_k rows of each query and task are shuffled.
    """
    spark = rows.sparkSession
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()) & (F.size("v") > 0)
    picked = rows.select(rows[id_col].cast("long").alias("i"), rows[vector_col].cast("array<double>").alias("v")).where(sound)
    asked = queries.select(queries[id_col].cast("long").alias("i"), queries[vector_col].cast("array<double>").alias("v")).where(sound)
    n = asked.count()
    blocks = max(1, -(-n // block))
    found: DataFrame | None = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()  # about ``block`` rows
        shared = spark.sparkContext.broadcast([(r.i, list(r.v)) for r in own])

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            groups: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for d in {len(v) for _, v in shared.value}:
                of_d = [(i, v) for i, v in shared.value if len(v) == d]
                groups[d] = np.array([i for i, _ in of_d]), _unit(np.array([v for _, v in of_d]))
            for batch in batches:
                lengths = np.diff(np.asarray(batch.column(1).offsets))
                for d, (qs, q) in groups.items():
                    part = batch.filter(pa.array(lengths == d))
                    if not part.num_rows:
                        continue
                    ids = np.asarray(part.column(0))
                    sims = q @ _unit(_matrix(part.column(1))).T
                    sims[qs[:, None] == ids[None, :]] = -2
                    order = np.broadcast_to(np.arange(len(ids)), sims.shape)
                    if len(ids) > top_k:  # all that reach the k-th, ties included, then only these are sorted
                        kth = np.partition(sims, len(ids) - top_k, axis=1)[:, len(ids) - top_k]
                        width = int((sims >= kth[:, None]).sum(axis=1).max())
                        order = np.argpartition(-sims, width - 1, axis=1)[:, :width] if width < len(ids) else order
                    near = np.take_along_axis(sims, order, axis=1)
                    order = np.take_along_axis(order, np.lexsort((ids[order], -near), axis=1)[:, :top_k], axis=1)
                    best = np.take_along_axis(sims, order, axis=1)
                    r, c = np.nonzero(best >= least)
                    yield pa.RecordBatch.from_arrays([pa.array(qs[r]), pa.array(ids[order[r, c]]), pa.array(best[r, c])], names=["query_id", "id", "similarity"])

        hits = picked.mapInArrow(search, "query_id bigint, id bigint, similarity double")
        found = hits if found is None else found.union(hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
