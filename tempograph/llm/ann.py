"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector o is rotated at random and kept as its signs (packed into 64-bit words) and one scalar, the inner product of o with
its own code. For a query q, rotated and rounded to four bits, the inner product <q, o> is estimated from counts of common bits and
the scalar; the error of the estimate is below ERROR * sqrt((1 - s^2) / s^2 / (d - 1)) with high probability. Rows whose upper bound
reaches the k-th best lower bound are reranked with the original vectors in double precision.

Every row is indexed. Rows are dealt to pieces of about ROW_BLOCK by hash, once; the queries (one of `every` rows) go to every piece.
A task holds the rows of its pieces one after the other and streams the queries past them, so nothing is broadcast, no row is sent
twice, and memory is bounded by a piece and a batch of queries; the k best of each piece are merged.

Vectors that are null, zero, of another length than the most frequent one, or with null or non-finite components take no part, nor
do rows with a null id. Of repeated rows of one id the first by value counts. Ties go to the smaller id. A query with no candidates
has no rows. Cosines are taken after scaling each vector by a power of two, so components of any magnitude neither overflow nor vanish.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table, tidy

#: Rows of a piece at most about, and at least where there are few (so that there are several tasks); factor of the error bound.
ROW_BLOCK, LEAST_BLOCK, ERROR, SEED = 65536, 4096, 3.0, 5


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose largest component is in [0.5, 1), by powers of two: cosines stay as they are."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def encode(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits (rows of 64-bit words) and correction scalars of unit vectors."""
    d = unit.shape[1]
    z = unit @ turn
    bits = z > 0
    scalar = np.abs(z).sum(1) / np.sqrt(d)
    return _packed(bits), scalar


def _packed(bits: np.ndarray) -> np.ndarray:
    n, d = bits.shape
    b = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(b, ((0, 0), (0, -b.shape[1] % 8))).view("<u8").reshape(n, -1)


def estimate(q: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of one rotated unit query with coded rows, and bounds of the error."""
    d = len(q)
    low = q.min()
    step = max((q.max() - low) / 15, 1e-12)
    level = np.rint((q - low) / step).astype(np.int64)
    total = np.zeros(len(codes))
    for j in range(4):
        plane = _packed(((level >> j) & 1).astype(bool)[None])[0]
        total += float(1 << j) * np.bitwise_count(codes & plane).sum(1)
    ones = np.bitwise_count(codes).sum(1)
    dot = (2 * (step * total + low * ones) - q.sum()) / np.sqrt(d)
    rounding = step / np.sqrt(12) * np.sqrt(2)
    s = np.maximum(scalars, 1e-6)
    return dot / s, ERROR * (np.sqrt(np.maximum(1 - s**2, 0) / s**2 / max(d - 1, 1)) + rounding / s)


class Piece:
    """Rows that queries are held against."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, codes: np.ndarray, scalars: np.ndarray) -> None:
        self.ids, self.codes, self.scalars, self.vectors = ids, codes, scalars, scaled(vectors)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, turn: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """(query_id, vec_id, cosine) of the k best rows for each query."""
        queries = scaled(queries)
        q_norms = np.sqrt((queries * queries).sum(1))
        turned = (queries / q_norms[:, None]) @ turn
        out = []
        for i, own in enumerate(query_ids):
            guess, error = estimate(turned[i], self.codes, self.scalars)
            other = self.ids != own
            lower = np.where(other, guess - error, -np.inf)
            if len(self.ids) > k:
                bound = np.partition(lower, -k)[-k]
                chosen = np.flatnonzero(other & (guess + error >= bound))
            else:
                chosen = np.flatnonzero(other)
            exact = (self.vectors[chosen] * queries[i]).sum(1) / (self.norms[chosen] * q_norms[i])
            if len(exact) > k:  # rows that tie with the k-th stay
                near = np.flatnonzero(exact >= np.partition(exact, -k)[-k])
                chosen, exact = chosen[near], exact[near]
            best = np.lexsort((self.ids[chosen], -exact))[:k]
            out += [(int(own), int(self.ids[chosen[j]]), float(exact[j])) for j in best]
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): rows with an id and a finite vector that isn't zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def build_index(vectors: DataFrame, seed: int = SEED) -> tuple[DataFrame, int]:
    """vec_id, v, code, scalar of every row that takes part, written to the shared folder; and the dimension.

    Repeated rows of one id meet in one shuffle; lengths are counted before it, in a scan.
    """
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes[0] if sizes else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(d, seed)
        for batch in batches:
            if batch.num_rows:
                x = scaled(np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(-1, d))
                codes, scalars = encode(x / np.linalg.norm(x, axis=1, keepdims=True), turn)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scalars)], ["vec_id", "v", "code", "scalar"])

    one_each = rows.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v"))
    return cut(one_each.mapInArrow(tidy(run), "vec_id long, v array<double>, code binary, scalar double")), d


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k nearest others by cosine."""
    index, d = build_index(vectors, seed)
    n = index.count()
    pieces = max(1, -(-n // ROW_BLOCK), min(64, -(-n // LEAST_BLOCK)))
    stored = index.select(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)).alias("piece"), F.lit(0).alias("part"), "vec_id", "v", "code", "scalar")
    asked = index.where(F.col("vec_id") % every == 0).select(F.explode(F.expr(f"sequence(0L, {pieces - 1}L)")).alias("piece"), F.lit(1).alias("part"), "vec_id", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("scalar"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, at, held, piece = rotation(d, seed), None, [], None
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            key = ids * 2 + parts
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                some = batch.slice(low, high - low)
                vec_ids, v = some.column(2).to_numpy(), np.array(some.column(3).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
                if ids[low] != at:
                    at, held, piece = ids[low], [], None
                if parts[low] == 0:
                    held.append((vec_ids, v, np.frombuffer(b"".join(some.column(4).to_pylist()), "<u8").reshape(len(v), -1), some.column(5).to_numpy()))
                    continue
                if piece is None and held:
                    piece, held = Piece(*map(np.concatenate, zip(*held))), []
                if piece is not None and (found := piece.search(vec_ids, v, turn, k)):
                    q, i, s = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    met = stored.union(asked).repartition(pieces, "piece").sortWithinPartitions("piece", "part").mapInArrow(tidy(run), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"))
