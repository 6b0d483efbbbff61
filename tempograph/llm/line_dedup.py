"""Line dedup by a sharded minimal perfect hash over the hashes of lines.

A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of LONG code points or more that stand in at least `least`
documents lose all their lines, except in the largest doc_id that holds them. Tasks send one row for each key they meet in a batch
(128 bits of hash, documents, largest doc_id), so neither lines nor copies of frequent ones are shuffled. Hashes that reach `least` are
dealt to shards. Each shard gets a minimal perfect hash: a cascade of bit arrays, in which a key owns the first bit that no other key
of its level hits; the rank of that bit among all set bits is the key's slot in arrays of fingerprints, counts and holders. Documents
probe these arrays for each of their lines; a line that isn't in the index fails the fingerprint (64 bits beside the 64 that lead
to the slot), so lines need not be joined.

Up to MAX_INDEX bytes the shards are broadcast together and one pass over the documents does the rest. A larger index is left where
it is: keys found in more than 1 / HOT of all places (so at most HOT keys) are broadcast as a small index of the same kind, the
other lines' hashes go to their shards, dealt by document where a shard gets many, and what is to be dropped comes back by document.

Each row is a document. Rows of one doc_id that hold a key as the largest one all keep it. A null doc_id is below all others, and a
key that only such rows hold stays. A null text is one empty line and comes back empty. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, tidy

LONG, LEAST = 40, 5
#: Keys of a shard, about; bytes of shards that are broadcast; share of all places from which a key is hot; probes of a shard's part.
SHARD, MAX_INDEX, HOT, PART = 32_768, 64_000_000, 4096, 1 << 20
NOBODY = -(1 << 63)
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def long_lines(text: bytes, least: int = LONG) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, places of those whose key has `least` code points or more, and these keys' 16-byte hashes."""
    import xxhash

    lines, places, hashes = text.split(b"\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= least and len(key := line.strip(_BLANK)) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least):
            places.append(i)
            hashes.append(xxhash.xxh3_128_digest(key.lower()))
    return lines, places, hashes


def _pairs(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def key_counts(docs: DataFrame, least: int) -> DataFrame:
    """h1, h2, n (documents), top (largest doc_id) of the keys that at least so many rows of docs (doc_id, text) hold."""
    names = ["h1", "h2", "n", "top"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                own = set(long_lines(text or b"")[2])
                hashes += own
                ids += [NOBODY if doc_id is None else doc_id] * len(own)
            if not hashes:
                continue
            (a, b), d = _pairs(hashes), np.array(ids, np.int64)
            order = np.lexsort((d, b, a))
            a, b, d = a[order], b[order], d[order]
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            end = np.append(first[1:], len(a))
            yield pa.RecordBatch.from_arrays([pa.array(a[first].view(np.int64)), pa.array(b[first].view(np.int64)), pa.array(end - first), pa.array(d[end - 1])], names)

    met = docs.select("doc_id", "text").mapInArrow(tidy(run), "h1 long, h2 long, n long, top long")
    return met.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("top").alias("top")).where(F.col("n") >= least)


def _spot(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    v = h1 + (h2 ^ (h2 >> np.uint64(32))) * _MIX[2] + np.uint64(level * int(_MIX[0]) % (1 << 64))
    v = (v ^ (v >> np.uint64(30))) * _MIX[0]
    v = (v ^ (v >> np.uint64(27))) * _MIX[1]
    return v ^ (v >> np.uint64(31))


def perfect_hash(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays (as 64-bit words) of a minimal perfect hash of distinct keys, and the keys' numbers in the order of their slots."""
    rest, words, slots, level = np.arange(len(h1)), [], [], 0
    while len(rest):
        size = -(-2 * len(rest) // 64) * 64
        at = (_spot(h1[rest], h2[rest], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, np.uint8)
        bits[at[alone]] = 1
        words.append(np.packbits(bits, bitorder="little").view(np.uint64))
        slots.append(rest[alone][np.argsort(at[alone])])
        rest, level = rest[~alone], level + 1
    return words, np.concatenate(slots) if slots else rest


def shards(keys: DataFrame, n: int) -> DataFrame:
    """shard, levels (its bit arrays), prints, counts, holders of n shards of keys (h1, h2, n, top), one row each."""

    def build(table: pa.Table) -> pa.Table:
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        words, order = perfect_hash(h1, h2)
        counts = np.minimum(table.column("n").to_numpy(), 2**32 - 1).astype(np.uint32)
        held = {"shard": [table.column("shard")[0].as_py()], "levels": [[w.tobytes() for w in words]], "prints": [h2[order].tobytes()], "counts": [counts[order].tobytes()], "holders": [table.column("top").to_numpy()[order].tobytes()]}
        return pa.table(held, pa.schema([("shard", pa.int64()), ("levels", pa.list_(pa.binary())), ("prints", pa.binary()), ("counts", pa.binary()), ("holders", pa.binary())]))

    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(n)))
    return dealt.groupBy("shard").applyInArrow(build, "shard long, levels array<binary>, prints binary, counts binary, holders binary")


class Index:
    """Shards put together: one run of words, in which the rank of a bit is the slot of its key."""

    def __init__(self, rows: list, n: int) -> None:
        depth = max([len(r["levels"]) for r in rows], default=0)
        self.n, self.begin, self.size = n, np.zeros((n, depth), np.int64), np.zeros((n, depth), np.int64)
        words, at = [], 0
        for r in rows:
            for k, level in enumerate(r["levels"]):
                words.append(np.frombuffer(level, np.uint64))
                self.begin[r["shard"], k], self.size[r["shard"], k] = at, 64 * len(words[-1])
                at += len(words[-1])
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.before = np.cumsum(np.append(0, np.bitwise_count(self.words))).astype(np.int64)
        joined = lambda name, kind: np.frombuffer(b"".join(r[name] for r in rows), kind)
        self.prints, self.counts, self.holders = joined("prints", np.uint64), joined("counts", np.uint32), joined("holders", np.int64)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that aren't in the index."""
        shard = np.mod(h1.view(np.int64), self.n)
        out, open_ = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level in range(self.size.shape[1]):
            size = self.size[shard[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            at = (_spot(h1[open_], h2[open_], level) % size.astype(np.uint64)).astype(np.int64)
            word, bit = self.begin[shard[open_], level] + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[self.prints[out[found]] != h2[found]]] = -1
        return out

    def probe(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is in the index, and whether its line goes from the document of that id."""
        slot = self.slots(h1, h2)
        known = slot >= 0
        goes = known.copy()
        held = slot[known]
        goes[known] = (self.counts[held] >= least) & (self.holders[held] != ids[known]) & (self.holders[held] != NOBODY)
        return known, goes


def _packed(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), row.alias("row"))


def _drop(rows: DataFrame, docs: DataFrame, decide) -> DataFrame:
    """docs with text less the lines that decide()(ids, places, h1, h2, extra of a batch) marks, n_lines and n_dropped.

    rows have four columns: a struct of those of docs, the id, the text and what decide needs.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    kept = [f if f.name != "text" else StructField("text", StringType()) for f in docs.schema.fields]
    schema = StructType([*kept, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    arrow = to_arrow_schema(schema)
    own = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = decide()
        for batch in batches:
            held = [long_lines(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            ids = np.array([NOBODY if x is None else x for x in batch.column(1).to_pylist()], np.int64)
            n = np.array([len(x[1]) for x in held], np.int64)
            h1, h2 = _pairs([d for x in held for d in x[2]])
            goes = mark(np.repeat(ids, n), n, h1, h2, batch.column(3))
            texts, dropped, at = [], [], 0
            for (lines, places, _), m in zip(held, n.tolist()):
                away = {p for p, g in zip(places, goes[at : at + m].tolist()) if g}
                at += m
                texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in away) if away else b"\n".join(lines))
                dropped.append(len(away))
            columns = [c.cast(arrow.field(i).type) for i, c in enumerate(batch.column(0).flatten())]
            columns[own] = pa.array(texts, pa.binary()).cast(pa.string()).cast(arrow.field(own).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(x[0]) for x in held], pa.int64()), pa.array(dropped, pa.int64())], schema=arrow)

    return rows.mapInArrow(tidy(run), schema)


def _routed(docs: DataFrame, keys: DataFrame, built: DataFrame, n: int, least: int) -> DataFrame:
    """The way for an index that is too large to send: hashes go to their shards."""
    spark = docs.sparkSession
    places = keys.agg(F.sum("n")).first()[0]
    frequent = spark.sparkContext.broadcast(Index(shards(keys.where(F.col("n") * HOT > places), 1).collect(), 1))
    row = F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text").cast("string"))
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row.alias("row"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, owner = [], []
            for i, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                own = set(long_lines(text or b"")[2])
                hashes += own
                owner += [i] * len(own)
            h1, h2 = _pairs(hashes)
            rest = np.flatnonzero(frequent.value.slots(h1, h2) < 0)
            at = pa.array(np.array(owner, np.int64)[rest])
            yield pa.RecordBatch.from_arrays([pa.array(h1[rest].view(np.int64)), pa.array(h2[rest].view(np.int64)), batch.column(0).take(at), batch.column(2).take(at)], ["h1", "h2", "doc_id", "row"])

    asked = cut(work.mapInArrow(tidy(ask), "h1 long, h2 long, doc_id long, row long"))
    parts = max(1, asked.count() // (n * PART))
    probes = asked.withColumns({"shard": F.pmod("h1", F.lit(n)), "part": F.pmod("row", F.lit(parts)), "index": F.lit(None).cast("struct<levels:array<binary>,prints:binary,counts:binary,holders:binary>")})
    index = built.select(F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.struct("levels", "prints", "counts", "holders").alias("index"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for batch in batches:
            shard, edges = batch.column(4).to_numpy(zero_copy_only=False), [0]
            held_at = set(np.flatnonzero(batch.column(6).is_valid().to_numpy(zero_copy_only=False)).tolist())
            edges = sorted({0, *np.flatnonzero(shard[1:] != shard[:-1]) + 1, *held_at, *(i + 1 for i in held_at), len(shard)})
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo in held_at:
                    of, held = int(shard[lo]), Index([batch.column(6)[lo].as_py() | {"shard": 0}], 1)
                elif of == shard[lo]:
                    h1, h2, ids, row = (batch.column(i).slice(lo, hi - lo) for i in range(4))
                    goes = held.probe(h1.to_numpy().view(np.uint64), h2.to_numpy().view(np.uint64), ids.fill_null(NOBODY).to_numpy(), least)[1]
                    yield pa.RecordBatch.from_arrays([row.filter(pa.array(goes)), h1.filter(pa.array(goes))], ["row", "h1"])

    sent = probes.unionByName(index).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("index").isNull())
    away = sent.mapInArrow(tidy(answer), "row long, h1 long").distinct().groupBy("row").agg(F.collect_list("h1").alias("away"))
    rows = _packed(docs, row).join(away, "row", "left").select("doc", "id", "text", "away")

    def decide():
        def mark(ids, n, h1, h2, away):
            known, goes = frequent.value.probe(h1, h2, ids, least)
            at = 0
            for m, own in zip(n.tolist(), away.to_pylist()):
                if own:
                    goes[at : at + m] |= ~known[at : at + m] & np.isin(h1[at : at + m].view(np.int64), np.array(own, np.int64))
                at += m
            return goes

        return mark

    return _drop(rows, docs, decide)


def drop_frequent_lines(docs: DataFrame, least: int = LEAST, most: int = MAX_INDEX) -> DataFrame:
    """docs with texts less their frequent lines, n_lines (before dropping) and n_dropped."""
    docs = docs.drop("n_lines", "n_dropped")
    work = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = cut(key_counts(work, least))
    n = max(1, keys.count() // SHARD)
    built = cut(shards(keys, n))
    size = built.agg(F.sum(F.octet_length("prints") + F.octet_length("counts") + F.octet_length("holders") + F.aggregate("levels", F.lit(0), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    if size > most:
        return _routed(docs, keys, built, n, least)
    index = docs.sparkSession.sparkContext.broadcast(Index(sorted(built.collect(), key=lambda r: r["shard"]), n))

    def decide():
        return lambda ids, n, h1, h2, _: index.value.probe(h1, h2, ids, least)[1]

    return _drop(_packed(docs, F.lit(0)), docs, decide)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {LONG} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST})
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (top IS NOT NULL AND top <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (top IS NULL OR top = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id
"""
