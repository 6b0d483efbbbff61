"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Each term has a sparse random index vector (from its hash). A term's context vector is the sum of the index vectors around it in
the learning texts, plus its own. A document is the mean and the spread of its terms' vectors with three shares (different terms,
terms that repeat the one before, terms out of the vocabulary). A tanh layer and a logistic one, trained with Adam in numpy, give a
score; a temperature fitted on a fifth of the learning rows makes it a probability.

Fitting uses at most MAX_ROWS labelled texts, chosen by hash, and at most MAX_CHARS characters in all (documented bounds, so the
model reaches the driver in bounded memory); every document is scored, whole. Terms outside the vocabulary share vectors by their
shape and hash. A null or empty text has a zero vector and gets a score too. A null doc_id is never learned from, held_out is false.
Repeated labels: quality is their largest. Without labels of both kinds, the score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table

DIM, ACTIVE, WINDOW, VOCABULARY, SHARED, HIDDEN = 64, 6, 2, 20_000, 64, 24
MAX_ROWS, MAX_CHARS, SEED = 6000, 60_000_000, 11
_TERM = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
SHAPES = ("lower", "title", "upper", "digits", "marks")


def _shape(term: str) -> int:
    if not term[0].isalpha():
        return 3 if term[0].isdigit() else 4
    return 0 if term.islower() else 2 if term.isupper() and len(term) > 1 else 1


class _Rows(dict):
    """Term -> row of the table of vectors; terms out of the vocabulary have rows by shape and hash."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        super().__init__(vocabulary)
        self.own = len(vocabulary)

    def __missing__(self, term: str) -> int:
        row = self.own + _shape(term) * SHARED + zlib.crc32(term.lower().encode("utf-8", "surrogatepass")) % SHARED
        if len(self) < self.own + 300_000:
            self[term] = row
        return row


def index_vectors(terms: list[str]) -> np.ndarray:
    out = np.zeros((len(terms), DIM), np.float32)
    for i, t in enumerate(terms):
        rng = np.random.default_rng([SEED, zlib.crc32(t.encode("utf-8", "surrogatepass"))])
        out[i, rng.choice(DIM, ACTIVE, replace=False)] = rng.integers(0, 2, ACTIVE) * 2 - 1
    return out


class Model:
    def __init__(self, vocabulary: dict[str, int], vectors: np.ndarray) -> None:
        self.vocabulary, self.vectors, self.squares = vocabulary, vectors, vectors**2
        self.w1 = self.b1 = self.w2 = None
        self.b2, self.temperature, self.constant = 0.0, 1.0, None

    def pool(self, texts: list[str], rows: _Rows) -> np.ndarray:
        out = np.zeros((len(texts), 2 * DIM + 3), np.float32)
        for i, t in enumerate(texts):
            terms = _TERM.findall(t)
            if not terms:
                continue
            r = np.fromiter(map(rows.__getitem__, terms), np.int64, len(terms))
            used, n = np.unique(r, return_counts=True)
            share = n.astype(np.float32) / len(r)
            mean = share @ self.vectors[used]
            out[i, :DIM] = mean
            out[i, DIM : 2 * DIM] = np.sqrt(np.maximum(share @ self.squares[used] - mean**2, 0))
            out[i, 2 * DIM :] = len(used) / len(r), float((r[1:] == r[:-1]).mean()) if len(r) > 1 else 0.0, float((r >= len(self.vocabulary)).mean())
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _train(model: Model, x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.01, decay: float = 1e-4) -> None:
    rng = np.random.default_rng(SEED)
    calibrate = rng.random(len(y)) < 0.2
    if len(set(y[~calibrate])) < 2 or len(set(y[calibrate])) < 2:
        calibrate[:] = False
    a, t = x[~calibrate], y[~calibrate]
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9))
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    step = 0
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(len(t)), max(1, len(t) // 512)):
            h = np.tanh(a[part] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3][0], -40, 40))) - t[part]) * weight[part] / len(part)
            back = np.outer(d, p[2]) * (1 - h**2)
            step += 1
            for i, g in enumerate((a[part].T @ back + decay * p[0], back.sum(0), h.T @ d + decay * p[2], np.array([d.sum()]))):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if step > 3000:
            break
    model.w1, model.b1, model.w2, model.b2 = p[0].astype(np.float32), p[1].astype(np.float32), p[2].astype(np.float32), float(p[3][0])
    z, t = (model.logits(x[calibrate]), y[calibrate]) if calibrate.any() else (model.logits(a), t)
    loss = lambda k: np.logaddexp(0, -np.where(t == 1, z, -z) / k).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))


def fit(rows: list[tuple[str, int]]) -> Model:
    """A model from (text, label 0 or 1)."""
    terms = [_TERM.findall(t) for t, _ in rows]
    counts = Counter(w for ts in terms for w in ts)
    chosen = [w for w, n in sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:VOCABULARY] if n > 1]
    vocabulary = {w: i for i, w in enumerate(chosen)}
    lookup = _Rows(vocabulary)
    names = chosen + [f"{s}:{k}" for s in SHAPES for k in range(SHARED)]
    index = index_vectors(names) + 0.0
    # Shape is part of what a term's neighbours see.
    shape = index_vectors([f"shape {s}" for s in SHAPES])
    kinds = np.array([_shape(w) for w in chosen] + [k for k in range(len(SHAPES)) for _ in range(SHARED)], int)
    index += 2 * shape[kinds]
    context = np.zeros_like(index)
    for ts in terms:
        r = np.fromiter(map(lookup.__getitem__, ts), np.int64, len(ts))
        for k in range(1, WINDOW + 1):
            np.add.at(context, r[k:], index[r[:-k]])
            np.add.at(context, r[:-k], index[r[k:]])
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    vectors = index / np.linalg.norm(index, axis=1, keepdims=True) + context
    model = Model(vocabulary, vectors.astype(np.float32))
    y = np.array([label for _, label in rows], float)
    if len(set(y.tolist())) < 2:
        model.constant = float(y.mean()) if len(y) else 0.5
        return model
    x = model.pool([t for t, _ in rows], lookup).astype(np.float64)
    shift, scale = x.mean(0), x.std(0) + 1e-3
    _train(model, (x - shift) / scale, y)
    model.b1 = (model.b1 - (shift / scale) @ model.w1).astype(np.float32)
    model.w1 = (model.w1 / scale[:, None]).astype(np.float32)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for rows (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY

    def make():
        m = shared.value
        rows = _Rows(m.vocabulary)

        def work(batch: pa.RecordBatch) -> dict:
            s = m.score(m.pool([t or "" for t in batch.column(1).to_pylist()], rows)).astype(float)
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return work

    return map_batches(docs.select("doc_id", "text", "held_out"), make, "doc_id long, held_out boolean, score double, predicted int")


def learning_rows(docs: DataFrame, labels: DataFrame, bound: int = MAX_ROWS, chars: int = MAX_CHARS) -> list[tuple[str, int]]:
    """About bound rows (text, quality) at most, chosen by hash of doc_id; texts that would exceed so many characters are left out.

    docs has held_out. What is taken is settled by ids and lengths, so that only texts within the bound leave their tasks.
    """
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    labels = labels.where(~held)
    n = labels.count()
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, bound / max(n, 1)) * 1_000_003)
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    sizes = docs.where("not held_out").select("doc_id", row.alias("row"), F.length(F.coalesce("text", F.lit(""))).alias("size")).join(chosen, "doc_id")
    taken, total = [], 0
    for doc_id, row_key, size, quality in sizes.select("doc_id", "row", "size", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "row").limit(2 * bound).collect():
        if total + size <= chars:
            total += size
            taken.append((len(taken), doc_id, row_key, int(quality)))
    spark = docs.sparkSession
    times = {}  # repeated rows are as many rows of the sample
    for _, _, key, _ in taken:
        times[key] = times.get(key, 0) + 1
    first = {key: (place, quality) for place, _, key, quality in reversed(taken)}
    wanted = F.broadcast(spark.createDataFrame([(key,) for key in first], "row long"))
    texts = {}
    for key, text in docs.where("not held_out").select(row.alias("row"), "text").join(wanted, "row", "left_semi").dropDuplicates(["row"]).toLocalIterator():
        texts[key] = text or ""
    return [(texts[key], quality) for key, (place, quality) in sorted(first.items(), key=lambda x: x[1][0]) for _ in range(times[key])]


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    return score(docs, fit(learning_rows(docs, labels)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
