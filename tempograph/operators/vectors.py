"""Exact nearest vectors: pieces of rows that queries are streamed past."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a piece about; a task holds one piece and a batch of queries.
PIECE = 65536
#: More than a vector has numbers.
DIMENSIONS = 1_000_000


def top_k(rows: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, vec_id, score, place: the k rows (vec_id, e) of the largest cosine to each query (query_id, e), but the query's own id.

    Vectors of one length are compared with each other; null ones and those that hold null or what isn't finite take no part, and
    one of zeros has a cosine of 0 to all. Rows are sent once, queries to every piece; the k best of each piece are merged.
    """
    sound = F.size("e").between(1, DIMENSIONS - 1) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows, queries = rows.where(sound), queries.where(sound)
    pieces = max(1, -(-rows.count() // PIECE))
    stored = rows.select((F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) * DIMENSIONS + F.size("e")).alias("piece"), F.lit(0).alias("part"), F.col("vec_id").alias("id"), "e")
    asked = queries.withColumn("piece", F.explode(F.expr(f"sequence(0L, {pieces - 1}L)"))).select((F.col("piece") * DIMENSIONS + F.size("e")).alias("piece"), F.lit(1).alias("part"), F.col("query_id").alias("id"), "e")

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        e = np.array([np.asarray(x, np.float64) for x in batch.column(3).to_pylist()]).reshape(batch.num_rows, -1)
        return e / np.maximum(np.sqrt((e * e).sum(1, keepdims=True)), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, held = None, [], []
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                if key[low] // 2 != at:
                    at, ids, held = key[low] // 2, [], []
                some = batch.slice(low, high - low)
                if key[low] % 2 == 0:
                    ids.append(some.column(2).to_numpy())
                    held.append(matrix(some))
                elif ids:
                    ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                    out = []
                    for own, q in zip(some.column(2).to_pylist(), matrix(some)):
                        score = np.round(held[0] @ q, digits)
                        score[ids[0] == own] = -np.inf
                        near = np.flatnonzero(score >= np.partition(score, -k)[-k]) if len(score) > k else np.arange(len(score))
                        near = near[np.lexsort((ids[0][near], -score[near]))][:k]
                        out += [(own, int(ids[0][i]), float(score[i])) for i in near if score[i] > -np.inf]
                    if out:
                        q, v, s = zip(*out)
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    met = stored.union(asked).repartition(pieces, "piece").sortWithinPartitions("piece", "part").mapInArrow(run, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
