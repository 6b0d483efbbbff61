"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound as rot2(a) * rot1(b) * c, a text is the sum (bundle) of its
trigrams, and a language's prototype is the sum of its learning texts' vectors, each of length one. A text gets the language of
the largest cosine. Prototypes are few and of fixed size. They are fitted on at most MAX_PER_LANG texts of each language, chosen by
hash (a documented bound for fitting; every text is scored, whole).

A text that is null or has no letter is `und` with score 0; so is every text if nothing can be learned. A null doc_id is not
learned from, and held_out is false. Ties go to the language that sorts first. Repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, sized, tidy

DIM, SYMBOLS, SEED, MAX_PER_LANG, CHUNK = 1024, 128, 7, 4000, 128
#: Trigrams that are remembered (4 KB each), and different ones that are counted at once.
KNOWN, SLICE = 32_768, 8192


class Bundler:
    """Texts to bundled trigram vectors; remembers up to KNOWN trigrams that it has bound."""

    def __init__(self, dim: int = DIM, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        letters = rng.integers(0, 2, (SYMBOLS, dim), dtype=np.int8) * 2 - 1
        self.dim, self.first, self.second, self.third = dim, np.roll(letters, 2, 1), np.roll(letters, 1, 1), letters
        self.place = np.full(SYMBOLS**3, -1, np.int32)
        self.vectors, self.n = np.empty((KNOWN, dim), np.float32), 0
        self.table = np.full(0x110000, -1, np.int16)

    def symbols(self, text: str) -> np.ndarray:
        """0 for what isn't a letter (runs as one), 1-26 for a-z, others by code point."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.table[points]
        if (s < 0).any():
            for p in np.unique(points[s < 0]).tolist():
                c = chr(p)
                self.table[p] = 0 if not c.isalpha() else p - 96 if 97 <= p <= 122 else 27 + p % (SYMBOLS - 27)
            s = self.table[points]
        gap = s == 0
        keep = np.ones(len(s), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        return s[keep].astype(np.int64)

    def _bound(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of distinct trigrams, SLICE at most."""
        new = codes[self.place[codes] < 0]
        if self.n + len(new) > KNOWN:  # bounds memory: forget all and begin anew
            self.place[:], self.n = -1, 0
            new = codes
        a, b, c = new // SYMBOLS**2, new // SYMBOLS % SYMBOLS, new % SYMBOLS
        self.place[new] = np.arange(self.n, self.n + len(new))
        self.vectors[self.n : self.n + len(new)] = self.first[a] * self.second[b] * self.third[c]
        self.n += len(new)
        return self.vectors[self.place[codes]]

    def bundle(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A unit vector for each text, and whether it has a letter; trigrams are counted SLICE different ones at a time."""
        parts, n, letter = [], [], []
        for t in texts:
            s = self.symbols(t)
            letter.append(bool((s > 0).any()))
            s = np.concatenate([[0], s, [0]]) if letter[-1] else s[:0]
            code = s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:] if len(s) >= 3 else s[:0]
            parts.append(code)
            n.append(len(code))
        codes = np.concatenate(parts) if parts else np.empty(0, np.int64)
        rows = np.repeat(np.arange(len(texts)), n)
        used, at = np.unique(codes, return_inverse=True)
        v = np.zeros((len(texts), self.dim), np.float32)
        for low in range(0, len(used), SLICE):
            some = used[low : low + SLICE]
            its = (at >= low) & (at < low + SLICE) if len(used) > SLICE else slice(None)
            counts = np.bincount(rows[its] * len(some) + at[its] - low, minlength=len(texts) * len(some)).reshape(len(texts), len(some))
            v += counts.astype(np.float32) @ self._bound(some)
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        return v, np.array(letter, bool)


def learn(learning: DataFrame, dim: int = DIM, bound: int = MAX_PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes, from rows (doc_id, text, lang); bound texts of each language about."""
    sizes = sized(learning.groupBy("lang").count())
    chosen = learning.join(sizes, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.least(F.lit(1.0), bound / F.col("count")) * 1_000_003)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(dim), {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(0, len(texts), CHUNK):
                v, ok = bundler.bundle(texts[i : i + CHUNK])
                for lang, x, good in zip(langs[i : i + CHUNK], v, ok):
                    if good:
                        sums[lang] = sums.get(lang, 0) + x.astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([np.round(x * 2**20).astype(np.int64).tolist() for x in sums.values()], pa.list_(pa.int64()))], ["lang", "bundle"])

    parts = chosen.select("lang", "text").mapInArrow(tidy(run), "lang string, bundle array<long>")
    rows = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("p")).orderBy("lang").collect()
    p = np.array([r[1] for r in rows], np.float64).reshape(-1, dim)
    return [r[0] for r in rows], (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def identify(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, lang_pred, score (cosine with the prototype, 0 to 1)."""
    dim = prototypes.shape[1] if len(languages) else DIM
    # Prototypes share what all languages share; the choice is made without it. Equal prototypes leave rounding only, which isn't
    # blown up, and cosines are compared to four digits, so that ties are ties.
    centred = prototypes - prototypes.mean(0) if len(languages) > 1 else prototypes
    centred = centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-2) if len(languages) else centred

    def make():
        bundler = Bundler(dim)

        def work(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score = [], []
            for i in range(0, len(texts), CHUNK):
                v, ok = bundler.bundle(texts[i : i + CHUNK])
                if len(languages):
                    best = np.round(v @ centred.T, 4).argmax(1)
                    cosine = np.clip((v * prototypes[best]).sum(1), 0, 1)
                for j, good in enumerate(ok.tolist()):
                    good = good and len(languages) > 0
                    pred.append(languages[best[j]] if good else "und")
                    score.append(float(cosine[j]) if good else 0.0)
            return {"doc_id": batch.column(0), "held_out": batch.column(2), "lang_pred": pred, "score": score}

        return work

    return map_batches(docs.select("doc_id", "text", "held_out"), make, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, held_out: int = 2, of: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents whose crc32(doc_id) mod `of` isn't held_out."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % of
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.coalesce(rest == held_out, F.lit(False)).alias("held_out"))
    languages, prototypes = learn(docs.where("doc_id is not null and lang is not null and text is not null and not held_out").select("doc_id", "text", "lang"))
    return identify(docs, languages, prototypes)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))
