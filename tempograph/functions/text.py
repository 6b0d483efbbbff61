"""Text governance: keys, redaction, HTML text, spans, similarity, multi-pattern scans and quotes."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import kept

#: Suffixes of titles, stripped once each in this order, and the marker of redacted text.
SUFFIXES = ["工程师", "工程師", "专员", "專員", "岗位", "職位", "职位"]
REDACTED = "[已脱敏]"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
ID_CARD, PHONE = r"(?<!\d)\d{17}[\dXx](?!\d)", r"(?<!\d)1[3-9]\d{9}(?!\d)"
CHAT_ID = r"(?i)(?:微信(?:号)?|wechat|wx)\s*[:：]?\s*[A-Za-z][A-Za-z0-9_\-]{5,19}"


def redact(text: Column) -> Column:
    """Identity numbers, mobile numbers, e-mail addresses, then chat ids."""
    for pattern in (ID_CARD, PHONE, EMAIL, CHAT_ID):
        text = F.regexp_replace(text, pattern, REDACTED)
    return text


def ascii_key(text: Column) -> Column:
    """The part of normalize_title that plain expressions can do."""
    return F.regexp_replace(F.lower(text), r"[\s()\[\]\-_/\\]+", "")


def title_key(title: str | None) -> str | None:
    if title is None:
        return None
    t = re.sub(r"[\s()（）\[\]【】\-—_/\\]+", "", unicodedata.normalize("NFKC", title).casefold())
    t = t.replace("研发", "开发").replace("研發", "开发")
    for s in SUFFIXES:
        t = t.removesuffix(s)
    return t.removesuffix("岗")


@F.pandas_udf(T.StringType())
def normalize_title(s: pd.Series) -> pd.Series:
    return s.map(title_key)


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_to_str(page: str | None) -> str | None:
    if page is None:
        return None
    p = _Text()
    p.feed(page)
    p.close()
    return "\n".join(p.parts)


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    return s.map(html_to_str)


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b)], dtype="float64")


def merge_spans(spans: Column) -> Column:
    """Sorted spans (start, end), those that touch or overlap as one."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(out) > 0) & (x["start"] <= F.get(out, F.size(out) - 1)["end"]), joined).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, step)


_WORD = re.compile(r"[0-9A-Za-z_]")


def whole_word(text: str, start: int, end: int) -> bool:
    """ASCII patterns need a boundary on both sides; a neighbour of another script is one."""
    if not text[start:end].isascii():
        return True
    return not (start and _WORD.match(text[start - 1])) and not (end < len(text) and _WORD.match(text[end]))


class Surfaces:
    """A dictionary of surfaces, found by the lengths that begin with a character."""

    def __init__(self, skill_of: dict[str, str]) -> None:
        self.skill_of = {p: s for p, s in skill_of.items() if p}
        self.lengths: dict[str, list[int]] = {}
        for p in self.skill_of:
            of = self.lengths.setdefault(p[0], [])
            if len(p) not in of:
                of.append(len(p))
        for of in self.lengths.values():
            of.sort(reverse=True)
        # ASCII surfaces begin words; a character that begins others, too, is looked at wherever it stands.
        free = sorted({p[0] for p in self.skill_of if not p.isascii()})
        bound = sorted(set(self.lengths) - set(free))
        inside = lambda cs: "[" + re.escape("".join(cs)) + "]"
        self.first = re.compile(inside(self.lengths)) if self.lengths else re.compile("(?!)")
        self.begins = re.compile("|".join([rf"(?<![0-9A-Za-z_]){inside(bound)}"] * bool(bound) + [inside(free)] * bool(free)) or "(?!)")

    def all_hits(self, text: str, first: re.Pattern | None = None) -> Iterator[tuple[int, int, str]]:
        """Every place of every surface, overlaps included, by start and the longest first."""
        for m in (first or self.first).finditer(text):
            for n in self.lengths[m[0]]:
                if (p := text[m.start() : m.start() + n]) in self.skill_of:
                    yield m.start(), m.start() + n, p

    def mentions(self, text: str) -> Iterator[tuple[int, int, str]]:
        """Whole words only, leftmost, then longest, none of which overlap."""
        done = 0
        for hit in self.all_hits(text, self.begins):
            if hit[0] >= done and whole_word(text, hit[0], hit[1]):
                done = hit[1]
                yield hit


def too_ambiguous(surface: Column, name: Column) -> Column:
    """Aliases of three ASCII letters or fewer in lower case are words more often than skills; a skill's own name stays."""
    return (surface != name) & surface.rlike(r"^[\x00-\x7f]{1,3}$") & (surface == F.lower(surface)) & (surface != F.upper(surface))


#: Surfaces of a dictionary that every task holds.
MAX_SURFACES = 1_000_000


def bounded(vocabulary: dict[str, str]) -> dict[str, str]:
    """A dictionary that may be sent to every task; an error beyond that."""
    if len(vocabulary) > MAX_SURFACES:
        raise ValueError(f"more than {MAX_SURFACES} surfaces: a dictionary is held by every task")
    return vocabulary


#: Rows of an Arrow batch where rows are texts; the session is set to it.
ROWS = 1000


def scan(docs: DataFrame, vocabulary: dict[str, str]) -> DataFrame:
    """doc_id, start, end, skill_id, surface of all mentions; vocabulary maps surfaces to skills, MAX_SURFACES at most."""
    bounded(vocabulary)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(frames):
        surfaces = Surfaces(shared.value)
        for f in frames:
            rows = [(i, s, e, surfaces.skill_of[p], p) for i, t in zip(f["doc_id"], f["text"]) if t for s, e, p in surfaces.mentions(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "skill_id", "surface"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int, skill_id string, surface string")


def first_mentions(hits: DataFrame) -> DataFrame:
    """Evidence: the first hit of each skill in each document."""
    first = hits.groupBy("doc_id", "skill_id").agg(F.min(F.struct("start", "end", "surface")).alias("h"))
    return first.select(F.concat_ws(".", F.lit("ev"), F.col("doc_id").cast("string"), "skill_id", F.col("h.start").cast("string")).alias("evidence_id"), "doc_id", "skill_id", F.col("h.start").alias("span_start"), F.col("h.end").alias("span_end"), F.col("h.surface").alias("quote"), F.concat(F.lit("ac:"), "skill_id").alias("extractor"), F.lit(0.9).alias("confidence"))


#: White space that ends of blocks lose, as Python's strip does.
BLANKS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u2028\u2029\u3000"


def placed_blocks(docs: DataFrame, *keys: str, least: int = 8) -> DataFrame:
    """keys, doc_id, start, end, block: runs of text up to and with a full stop or line end; the mark counts for the least length."""
    part = lambda p, last: F.struct((last["end"]).alias("start"), (last["end"] + F.length(p)).alias("end"), F.btrim(p, F.lit(BLANKS)).alias("block"))
    zero = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("block")))
    parts = F.aggregate(F.split("text", r"(?<=[。\n])"), zero, lambda out, p: F.concat(out, F.array(part(p, F.element_at(out, -1)))))
    rows = docs.select(*keys, "doc_id", F.explode(parts).alias("b")).select(*keys, "doc_id", "b.*")
    return rows.where(F.length("block") >= least)


def blocks(docs: DataFrame, by: str, least: int = 8) -> DataFrame:
    """by, doc_id, block: runs of text that a full stop or a line end closes; the full stop is part of it."""
    b = docs.select(by, "doc_id", F.explode(F.split("text", r"(?<=[。\n])")).alias("block")).withColumn("block", F.btrim("block", F.lit(BLANKS)))
    return b.where(F.length("block") >= least)


def shared_blocks(docs: DataFrame, by: str) -> DataFrame:
    """by, block, n_docs: blocks that several documents of one source have."""
    return blocks(docs, by).select(by, "doc_id", "block").distinct().groupBy(by, "block").agg(F.count("*").alias("n_docs")).where("n_docs > 1")


#: A sketch has four bits of each of 240 minima. Blocks meet in bands of ten of them, 24 bands from each of eight orders: two of similarity
#: 0.8 meet and agree in as many minima as is asked for with a probability of 1 - 5e-6.
MINIMA, PER_BAND, ORDERS = 240, 10, 8
#: Calls of Python that the cells are dealt to; characters of a source whose blocks meet in one cell of each size, at most.
SHARDS, TILE = 1024, 1_000_000_000
#: Candidates of a block that are verified before the others; rows that are sent to all tasks, at most.
NEAREST, MAX_SENT = 8, 1_000_000


def gram_set(text: str) -> np.ndarray:
    """The distinct character 3-grams of the folded text, each as one number."""
    c = np.frombuffer(text.casefold().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(c) < 3:
        c = np.concatenate([c, np.zeros(3 - len(c), np.uint64)])
    return np.unique(c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42))


def sketches(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """How many 3-grams each text has, and its sketch: two minima a byte. All texts go through a hash function together."""
    rng = np.random.default_rng(17)
    odd, mask = (rng.integers(0, 2**32, MINIMA, dtype=np.uint64).astype(np.uint32) for _ in range(2))
    folded = [t.casefold().ljust(3, "\0") for t in texts]
    long = np.fromiter(map(len, folded), np.int64, len(folded))
    c = np.frombuffer(("".join(folded) + "\0\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    x = c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    x = ((x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(32)).astype(np.uint32)
    end = np.cumsum(long)
    text = np.repeat(np.arange(len(texts)), long)
    own = np.arange(len(x)) < (end - 2)[text]  # others reach into the next text
    grams = np.sort(text[own].astype(np.uint64) << np.uint64(32) | x[own])
    grams = grams[np.r_[True, grams[1:] != grams[:-1]]]
    sizes = np.bincount((grams >> np.uint64(32)).astype(np.int64), minlength=len(texts))
    low, h, at = np.empty((MINIMA, len(texts)), np.uint32), np.empty_like(x), np.stack([end - long, end - 2], 1).ravel()
    for i in range(MINIMA):
        np.bitwise_xor(x, mask[i], out=h)
        np.multiply(h, odd[i] | np.uint32(1), out=h)
        low[i] = np.minimum.reduceat(h, at)[::2]
    bits = (low * np.uint32(0x9E3779B1) >> np.uint32(28)).astype(np.uint8)
    return sizes, np.ascontiguousarray((bits[::2] | bits[1::2] << 4).T)


def sketched(blocks: DataFrame) -> DataFrame:
    """source, tiles, s, t, n, sketch: of the same block (s) in the same texts (t) a task leaves two rows at most, those of two texts."""

    def run(frames):
        seen: dict[int, int | None] = {}
        for f in frames:
            rows = []
            for i, (s, t) in enumerate(zip(f["s"].tolist(), f["t"].tolist())):
                if s not in seen:
                    seen[s] = t
                elif seen[s] is None or seen[s] == t:
                    continue
                else:
                    seen[s] = None
                rows.append(i)
            if len(seen) > 200_000:
                seen.clear()
            some = f.iloc[rows]
            slab = some["block"].str.len().cumsum() // 2**16  # what fits into a cache
            made = [sketches(g.tolist()) for _, g in some["block"].groupby(slab)]
            if made:
                n, bits = (np.concatenate(x) for x in zip(*made))
                yield some[["source", "tiles", "s", "t"]].assign(n=n.astype(np.int32), sketch=[r.tobytes() for r in bits])

    return blocks.mapInPandas(run, "source long, tiles int, s long, t long, n int, sketch binary")


def partners(sketches: DataFrame, threshold: float, late: DataFrame | None = None) -> DataFrame:
    """s, o, more: blocks s of a single text with blocks o that may be alike, and (s, s) for those of several texts.

    Blocks lie in cells by source and size, each in that of its size and in the next smaller one. A cell is sorted by each band, and
    who meets there stays if enough minima agree. A block whose band has shown it some that are alike by all appearance looks no
    further there, and one with some of these has only its nearest ones as rows; more says that there may be others. The late blocks
    (s), if given, have all, and others none.
    """
    p = threshold + (1 - threshold) / 16
    agreed = lambda n, off: n * p + off * (n * p * (1 - p)) ** 0.5
    least, least_early, likely, early = agreed(MINIMA, -5.2), agreed(80, -5.2), agreed(MINIMA, 0), 5  # five words have 80 minima
    ratio = threshold - 0.01  # sizes are counted by hashes
    nearest, every = NEAREST, late is not None

    def agreeing(words: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for i in range(0, len(x), 2**14):
            d = words[x[i : i + 2**14]] ^ words[y[i : i + 2**14]]
            d |= d >> np.uint64(1)
            d |= d >> np.uint64(2)
            out[i : i + 2**14] = 16 * words.shape[1] - np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1)
        return out

    def run(f: pd.DataFrame) -> pd.DataFrame:
        cell, s, t = (f[c].to_numpy() for c in ("cell", "s", "t"))
        o = np.lexsort((t, s, cell))
        cell, s, t = cell[o], s[o], t[o]
        new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (s[1:] != s[:-1])])
        first, single = t[new], t[new] == t[np.r_[new[1:], len(t)] - 1]
        cell, s, o = cell[new].view(np.uint64), s[new], o[new]
        size, upper, asks = (f[c].to_numpy()[o] for c in ("n", "upper", "asks"))
        asks = asks & single
        packed = np.frombuffer(b"".join(f["sketch"].to_numpy()[o]), np.uint8).reshape(len(o), -1)
        bits = np.stack([packed.T & 15, packed.T >> 4], 1).reshape(MINIMA, len(o))
        words = packed.view(np.uint64)
        lead, count, more = np.ascontiguousarray(words[:, :early]), len(o), np.zeros(len(o), bool)
        low, high, shift = (size * ratio).astype(np.float32), size.astype(np.float32), np.uint64(count.bit_length())

        def fitting(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Pairs, each as one number, and how many minima agree."""
            fit = (low[x] <= high[y]) & (low[y] <= high[x]) & ~(upper[x] & upper[y])
            x, y = x[fit], y[fit]
            fit = agreeing(lead, x, y) >= least_early
            x, y = np.minimum(x, y)[fit], np.maximum(x, y)[fit]
            agree = agreeing(words, x, y)
            fit = (agree >= least) & (asks[x] | asks[y]) & ~(single[x] & single[y] & (first[x] == first[y]))
            return (x * count + y)[fit], agree[fit]

        def distinct() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([q for q, _ in found]), return_index=True)
            return pairs, np.concatenate([g for _, g in found])[at]

        found = [fitting(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        rng = np.random.default_rng(18)
        for band in np.concatenate([rng.permutation(MINIMA).reshape(-1, PER_BAND) for _ in range(ORDERS)]):
            key = np.zeros(count, np.uint64)
            for c in band:
                key <<= np.uint64(4)
                key |= bits[c]
            key = (key + cell) * np.uint64(0x9E3779B97F4A7C15) >> shift << shift | np.arange(count, dtype=np.uint64)  # rows are sorted with their keys
            key.sort()
            o, key = (key & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64), key >> shift
            at, met, step = np.flatnonzero(key[1:] == key[:-1]), np.zeros(count, np.int32), 1
            while len(at):
                pairs, agree = fitting(o[at], o[at + step])
                found.append((pairs, agree))
                if not every:
                    pairs = pairs[agree >= likely]
                    np.add.at(met, np.concatenate([pairs // count, pairs % count]), 1)
                    busy = asks & (met < nearest)
                    on = busy[o[at]] | busy[o[at + step]]
                    more[o[at[~on]]] = more[o[at[~on] + step]] = True
                    at = at[on]
                step += 1
                at = at[at + step < count]
                at = at[key[at] == key[at + step]]
            if len(found) > 1000 or sum(len(q) for q, _ in found) > 2_000_000:
                found = [distinct()]
        pairs, agree = distinct()
        x, y = pairs // count, pairs % count
        x, y, agree = np.r_[x[asks[x]], y[asks[y]]], np.r_[y[asks[x]], x[asks[y]]], np.r_[agree[asks[x]], agree[asks[y]]]
        if not every:
            o = np.lexsort((-agree, x))
            x, y = x[o], y[o]
            settled = np.bincount(x, agree[o] >= likely, count) >= nearest
            near = ~settled[x] | (np.arange(len(x)) - np.searchsorted(x, x) < nearest)
            more[x[~near]] = True
            x, y = x[near], y[near]
        shared = s[~single & ~upper]
        return pd.DataFrame({"s": np.r_[s[x], shared], "o": np.r_[s[y], shared], "more": np.r_[more[x], np.zeros(len(shared), bool)]})

    size = F.floor(F.log(F.col("n")) / F.lit(-np.log(ratio).item())).cast("int")
    tile = F.pmod("s", "tiles").cast("int")
    both = sketches.select("*", F.explode(F.array(F.struct(size.alias("size"), F.lit(False).alias("upper")), F.struct((size - 1).alias("size"), F.lit(True).alias("upper")))).alias("at"), tile.alias("tile"))
    both = both.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    both = both.select(F.xxhash64("source", "at.size", F.least("tile", "other"), F.greatest("tile", "other")).alias("cell"), "at.upper", "s", "t", "n", "sketch")
    if late is None:
        both = both.withColumn("asks", F.lit(True))
    else:  # only their cells
        both = both.join(sent(both.join(late, "s", "left_semi").select("cell").distinct()), "cell", "left_semi")
        both = both.join(late.withColumn("asks", F.lit(True)), "s", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    return both.groupBy(F.pmod("cell", F.lit(SHARDS)).alias("shard")).applyInPandas(run, "s long, o long, more boolean")


@F.pandas_udf(T.DoubleType())
def gram_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        g, h = gram_set(x), gram_set(y)
        common = len(np.intersect1d(g, h, assume_unique=True))
        return common / (len(g) + len(h) - common)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")


def sent(df: DataFrame) -> DataFrame:
    """df, sent to all tasks where it is joined, unless it has too many rows for that."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= MAX_SENT else df


def near_blocks(docs: DataFrame, by: str, threshold: float = 0.8) -> DataFrame:
    """by, block: blocks to which a block of another text of one source is alike, equal or by sets of character 3-grams.

    Texts stay where they are: of a block its hash, that of its text and a sketch of 120 bytes travel, twice. Where sketches meet, pairs
    that can't be alike are left, nearly all of them. The blocks of the rest are read once more, and exact Jaccard verifies the pairs.
    Of large groups of near copies these are each block's nearest ones; blocks that find no partner so meet all others in a second round.
    """
    texts = docs.where(F.col(by).isNotNull()).select(by, F.unhex(F.md5(F.col("text").cast("binary"))).alias("doc_id"), "text")  # copies of a text have one digest
    large = docs.groupBy(by).agg(F.sum(F.length("text")).alias("long")).where(F.col("long") > TILE)
    tiles = F.coalesce(F.ceil(F.col("long") / TILE), F.lit(1)).cast("int").alias("tiles")
    hashed = texts.join(F.broadcast(large), by, "left").select(by, F.struct(F.xxhash64("text").alias("t"), tiles).alias("doc_id"), "text")
    name = F.xxhash64(by, "block").alias("s")
    found = kept(sketched(blocks(hashed, by).select(F.xxhash64(by).alias("source"), "doc_id.tiles", name, "doc_id.t", "block")))

    def alike(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """by, block, s, only (its text, if there is one): the blocks of pairs (s, o); and those of a single text that are alike to another."""
        asked = sent(pairs.select(F.explode(F.array("s", "o")).alias("s")).distinct())
        b = blocks(texts, by).withColumn("s", name).join(asked, "s", "left_semi").groupBy(by, "block", "s").agg(F.min("doc_id").alias("only"), F.max("doc_id").alias("last"))
        b = kept(b.select(by, "block", "s", F.when(F.col("only") == F.col("last"), F.col("only")).alias("only")))
        side = lambda n: b.select(*[F.col(c).alias(f"{c}_{n}") for c in b.columns])
        apart = (F.col(f"{by}_a") == F.col(f"{by}_b")) & (F.col("only_a").isNull() | F.col("only_b").isNull() | (F.col("only_a") != F.col("only_b")))
        pairs = pairs.where("s <> o").select(F.least("s", "o").alias("s_a"), F.greatest("s", "o").alias("s_b")).distinct()
        both = pairs.join(side("a"), "s_a").join(side("b"), "s_b").where(apart & (gram_jaccard("block_a", "block_b") >= threshold))
        sides = F.explode(F.array(*[F.struct(*[F.col(f"{c}_{n}").alias(c) for c in b.columns]) for n in "ab"])).alias("b")
        return b, kept(both.select(sides).select("b.*").where("only is not null").distinct())

    met = kept(partners(found, threshold))
    b, near = alike(met)
    late = sent(met.where("more").select("s").distinct().join(b.where("only is not null"), "s", "left_semi").join(near.select("s"), "s", "left_anti"))
    if not late.isEmpty():
        near = near.union(alike(kept(partners(found, threshold, late).where("s <> o")))[1]).distinct()
    return b.where("only is null").select(by, "block").union(near.select(by, "block"))


#: Phrases on benefits that say nothing about skills.
BENEFITS = ["五险一金", "周末双休", "双休", "团队氛围好", "带薪年假", "节日福利", "定期体检", "年终奖", "加班费", "扁平化管理", "免费零食", "零食下午茶", "弹性工作", "缴纳公积金"]


def places_of(text: str, phrases: list[str]) -> list[tuple[int, int]]:
    """Spans of phrases, those of longer phrases first; what overlaps a taken one isn't."""
    taken: list[tuple[int, int]] = []
    for p in sorted(phrases, key=len, reverse=True):
        for m in re.finditer(re.escape(p), text):
            if all(m.end() <= s or m.start() >= e for s, e in taken):
                taken.append(m.span())
    return sorted(taken)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(SPANS)
def benefit_spans(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [{"start": a, "end": b} for a, b in places_of(t, BENEFITS)] if t else [])


def boilerplate(docs: DataFrame, by: str, peers: bool = True) -> DataFrame:
    """doc_id, spans (merged): phrases on benefits and, if asked for, blocks that other texts of one `by` have, or nearly."""
    some = "|".join(BENEFITS)
    phrases = docs.where(F.col("text").rlike(some)).select("doc_id", F.explode(benefit_spans("text")).alias("s")).select("doc_id", "s.*")
    if peers:
        mark = F.unhex(F.md5(F.col("block").cast("binary"))).alias("mark")  # blocks meet by digests, their texts stay where they are
        known = sent(near_blocks(docs, by).select(by, mark))
        placed = placed_blocks(docs, by).select(by, "doc_id", "start", "end", mark)
        phrases = phrases.unionByName(placed.join(known, [by, "mark"], "left_semi").select("doc_id", "start", "end"))
    found = phrases.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("s"))
    return docs.select("doc_id").join(found.select("doc_id", merge_spans(F.col("s")).alias("spans")), "doc_id", "left").select("doc_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _letters(text: str) -> np.ndarray:
    """Length, then how many characters fall in each of 31 classes."""
    out = np.bincount(np.fromiter((1 + ord(c) % 31 for c in text), np.int64, len(text)), minlength=32).astype(np.int32)
    out[0] = len(text)
    return out


class _Stretch:
    """Canonical rows of a stretch of days, with what bounds the similarity of their titles."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.letters = np.zeros((16, 32), np.int32)

    def add(self, row: tuple) -> None:
        if len(self.rows) == len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[len(self.rows)] = _letters(row[3])
        self.rows.append(row)

    def like(self, own: np.ndarray, least: float) -> list[tuple]:
        """The rows, in order, whose titles have enough characters in common to be that similar."""
        of = self.letters[: len(self.rows)]
        both = of[:, 0] + own[0]
        fit = np.flatnonzero(200.0 * np.minimum(of[:, 0], own[0]) >= least * both)
        common = np.minimum(of[fit, 1:], own[1:]).sum(1)
        return [self.rows[i] for i in fit[200.0 * common >= least * both[fit]].tolist()]


def greedy_duplicates(rows: DataFrame, by: list[str], days: int = 60, least: float | None = 92.0, order: tuple[str, ...] = ("day", "posting_id")) -> DataFrame:
    """posting_id, duplicate_of: in arrival order, the first canonical row of the block within days whose title fits.

    rows has posting_id, day, title and the columns of by and order. Titles are compared by their keys; least None asks for equal
    ones. Rows without a day, or with an empty title or part of by, have no duplicate and are none's. A task reads its blocks one
    after the other, sorted, and holds the canonical rows of one block by stretches of days and by title.
    """
    rows = rows.withColumn("key", normalize_title("title")).withColumn("number", F.datediff("day", F.lit("1970-01-01")))
    fit = F.col("number").isNotNull() & (F.coalesce("key", F.lit("")) != "")
    for b in by:
        fit = fit & F.col(b).isNotNull() & (F.col(b).cast("string") != "")
    shape = "posting_id long, duplicate_of long"

    def run(frames):
        at, equal, near, count = None, {}, {}, 0
        for f in frames:
            out = []
            for i, group, day, key in zip(f["posting_id"], zip(*(f[b] for b in by)), f["number"], f["key"]):
                if group != at:
                    at, equal, near, count = group, {}, {}, 0
                if order[0] == "day" and near and min(near) < day // (days + 1) - 1:  # days ascend, so those before are too old for all to come
                    old = {s for s in near if s < day // (days + 1) - 1}
                    near = {s: x for s, x in near.items() if s not in old}
                    equal = {k: x for k, x in equal.items() if k[1] not in old}
                stretch = day // (days + 1)
                found = [(n, c) for s in (stretch - 1, stretch, stretch + 1) for n, c, d in equal.get((key, s), ()) if abs(d - day) <= days]
                if least is not None:
                    best = min(found, default=(float("inf"), None))[0]
                    own = _letters(key)
                    for s in (stretch - 1, stretch, stretch + 1):
                        for n, c, d, k in near[s].like(own, least) if s in near else ():
                            if n >= best:
                                break
                            if abs(d - day) <= days and k != key and indel(key, k) >= least:
                                best = n
                                found.append((n, c))
                                break
                hit = min(found)[1] if found else None
                if hit is None:
                    n, count = count, count + 1
                    equal.setdefault((key, stretch), []).append((n, i, day))
                    if least is not None:
                        near.setdefault(stretch, _Stretch()).add((n, i, day, key))
                out.append((i, hit))
            yield pd.DataFrame({"posting_id": pd.array([i for i, _ in out], "Int64"), "duplicate_of": pd.array([h for _, h in out], "Int64")})  # no floats between

    sorted_rows = rows.where(fit).select("posting_id", *by, "number", "key", *[F.col(o).alias(f"order_{k}") for k, o in enumerate(order)]).repartition(*by).sortWithinPartitions(*by, *[f"order_{k}" for k in range(len(order))])
    return sorted_rows.mapInPandas(run, shape).unionByName(rows.where(~fit | fit.isNull()).select("posting_id", F.lit(None).cast("long").alias("duplicate_of")))


_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def fold(text: str) -> tuple[str, np.ndarray]:
    """The text in NFKC, character by character, without white space, and for each of its characters the place in the text."""
    if text.isascii() or unicodedata.is_normalized("NFKC", text):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kept = np.flatnonzero(~np.isin(points, _SPACES))
        return points[kept].tobytes().decode("utf-32-le", "surrogatepass"), kept
    out, at = [], []
    for i, c in enumerate(text):
        for x in c if c.isascii() else unicodedata.normalize("NFKC", c):
            if not x.isspace():
                out.append(x)
                at.append(i)
    return "".join(out), np.array(at, np.int64)


class Quotes:
    """Places of many quotes in a text: hashes of all its windows meet those of the quotes' beginnings, then texts are compared."""

    WIDTH = 8

    def __init__(self, quotes: list[tuple[int, str]]) -> None:
        self.by_width: dict[int, dict[int, list[tuple[int, str]]]] = {}
        for i, q in quotes:
            if q:
                w = min(self.WIDTH, len(q))
                self.by_width.setdefault(w, {}).setdefault(int(self.windows(q[:w], w)[0]), []).append((i, q))
        self.known = {w: np.sort(np.array(list(d), np.uint64)) for w, d in self.by_width.items()}

    @staticmethod
    def windows(text: str, width: int) -> np.ndarray:
        """A hash of each window of code points."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        h = np.zeros(max(len(c) - width + 1, 0), np.uint64)
        for k in range(width if len(h) else 0):
            h = (h + c[k : len(c) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(quote, start, end) of all places, overlaps included."""
        out = []
        for w, known in self.known.items():
            h = self.windows(text, w)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            for p in np.flatnonzero(known[at] == h).tolist():
                out += [(i, p, p + len(q)) for i, q in self.by_width[w][int(h[p])] if text.startswith(q, p)]
        return out


#: Characters of quotes that are broadcast at most; larger tables meet the texts by a join on the hashes.
MAX_QUOTES = 20_000_000


def locate(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """item_id, doc_id, start, end: all places of quotes (item_id, quote) in texts; where a text has none, those of the
    folded quote in the folded text. Blank quotes have no place."""
    quotes = quotes.where(F.length(F.btrim("quote", F.lit(BLANKS))) > 0).select(F.col("item_id").cast("long").alias("item_id"), "quote")
    shape = "item_id long, doc_id long, start int, end int"
    size = quotes.agg(F.sum(F.length("quote")), F.count("*")).first()
    if (size[0] or 0) + 40 * size[1] <= MAX_QUOTES:
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in quotes.collect()])

        def run(frames):
            every = shared.value
            exact, folded = Quotes(every), Quotes([(i, fold(q)[0]) for i, q in every])
            for f in frames:
                rows = []
                for doc, t in zip(f["doc_id"], f["text"]):
                    rows += [(i, doc, s, e) for i, s, e in places(exact, folded, t)] if t else []
                yield pd.DataFrame(rows, columns=["item_id", "doc_id", "start", "end"])

        def places(exact, folded, t):
            found = exact.hits(t)
            yield from found
            has, (flat, at) = {i for i, _, _ in found}, fold(t)
            for i, s, e in folded.hits(flat):
                if i not in has:
                    yield i, int(at[s]), int(at[e - 1]) + 1

        return docs.select("doc_id", "text").mapInPandas(run, shape)
    return _locate_by_join(docs, quotes)


#: Beginnings of quotes whose hashes every task holds; with more, all windows of texts travel. Places of a text that are verified together.
MAX_BEGINNINGS, STRETCH = 4_000_000, 10_000


def _locate_by_join(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """locate for quotes of any number: windows of texts join the beginnings of quotes, exact ones and folded ones.

    Windows have the widths that quotes begin with, and those whose hash no quote has are left in their tasks. The hits in a stretch of
    a text are gathered before the text joins them, so it is copied for a stretch, not for a hit.
    """
    width = Quotes.WIDTH

    def beginnings(frames):
        for f in frames:
            rows = [(i, k, min(width, len(x)), int(Quotes.windows(x[: min(width, len(x))], min(width, len(x))).view(np.int64)[0]), x) for i, q in zip(f["item_id"], f["quote"]) for k, x in ((0, q), (1, fold(q)[0])) if x]
            yield pd.DataFrame(rows, columns=["item_id", "kind", "width", "hash", "form"])

    b = kept(quotes.mapInPandas(beginnings, "item_id long, kind int, width int, hash long, form string"))
    keys = b.select("kind", "width", "hash").distinct()
    sizes = {(r.kind, r.width): r["count"] for r in keys.groupBy("kind", "width").count().collect()}  # at most 2 * width
    known = dict.fromkeys(sizes)
    if sum(sizes.values()) <= MAX_BEGINNINGS:
        rows = keys.collect()
        known = {k: np.sort(np.array([r.hash for r in rows if (r.kind, r.width) == k], np.int64)) for k in sizes}
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def windows(frames):
        for f in frames:
            for doc, t in zip(f["doc_id"], f["text"]):
                forms = {0: t or "", 1: fold(t)[0] if t else ""}
                for (kind, w), some in shared.value.items():
                    h = Quotes.windows(forms[kind], w).view(np.int64)
                    p = np.arange(len(h)) if some is None else np.flatnonzero(some[np.minimum(np.searchsorted(some, h), len(some) - 1)] == h)
                    for lo in range(0, len(p), 100_000):
                        at = p[lo : lo + 100_000]
                        yield pd.DataFrame({"doc_id": doc, "kind": kind, "width": w, "hash": h[at], "place": at})

    w = docs.select("doc_id", "text").mapInPandas(windows, "doc_id long, kind int, width int, hash long, place int")
    hits = w.join(b, ["kind", "width", "hash"]).select("doc_id", F.struct("item_id", "kind", "form", "place").alias("hit"))
    near = hits.groupBy("doc_id", F.floor(F.col("hit.place") / STRETCH).alias("stretch")).agg(F.collect_list("hit").alias("hits")).join(docs.select("doc_id", "text"), "doc_id")

    def verify(frames):
        for f in frames:
            rows = []
            for doc, hits, t in zip(f["doc_id"], f["hits"], f["text"]):
                flat = None
                for hit in hits:
                    item, kind, form, p = (hit[c] for c in ("item_id", "kind", "form", "place"))
                    if kind and flat is None:
                        flat = fold(t)
                    x, at = (t, None) if kind == 0 else flat
                    if x.startswith(form, p):
                        rows.append((item, doc, kind, p, p + len(form)) if at is None else (item, doc, kind, int(at[p]), int(at[p + len(form) - 1]) + 1))
            yield pd.DataFrame(rows, columns=["item_id", "doc_id", "kind", "start", "end"])

    found = near.select("doc_id", "hits", "text").mapInPandas(verify, "item_id long, doc_id long, kind int, start int, end int")
    exact = found.where("kind = 0")
    return exact.unionByName(found.where("kind = 1").join(exact.select("item_id", "doc_id"), ["item_id", "doc_id"], "left_anti")).drop("kind")


def first_places(text: str | None, quotes: list[str | None]) -> list[tuple[int, int] | None]:
    """Where each quote stands first in one text, by the rules of locate."""
    out, flat = [], None
    for q in quotes:
        found = None
        if text and q and q.strip(BLANKS):
            p = text.find(q)
            if p >= 0:
                found = p, p + len(q)
            elif short := fold(q)[0]:
                flat = fold(text) if flat is None else flat
                p = flat[0].find(short)
                if p >= 0:
                    found = int(flat[1][p]), int(flat[1][p + len(short) - 1]) + 1
        out.append(found)
    return out


def pick_places(hits: DataFrame, hints: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """item_id, doc_id, start, end: of all places of a quote in a text the one nearest to its hint, the first without one.

    hints is (item_id, doc_id, hint); parts (doc_id, part_start, part_end) are the text's blocks: places in the hint's block come first.
    """
    h = hits.join(hints.select("item_id", "doc_id", "hint"), ["item_id", "doc_id"], "left") if hints is not None else hits.withColumn("hint", F.lit(None).cast("int"))
    if parts is not None:
        own = h.select("item_id", "doc_id", "hint").where("hint is not null").distinct().join(parts, "doc_id").where("part_start <= hint and hint < part_end")
        own = own.groupBy("item_id", "doc_id").agg(F.min(F.struct("part_start", "part_end")).alias("own"))
        h = h.join(own, ["item_id", "doc_id"], "left")
        away = ~F.coalesce((F.col("start") >= F.col("own.part_start")) & (F.col("start") < F.col("own.part_end")), F.lit(False))
    else:
        away = F.lit(False)
    best = F.min_by(F.struct("start", "end"), F.struct(away.alias("away"), F.coalesce(F.abs(F.col("start") - F.col("hint")), F.lit(0)).alias("off"), "start"))
    return h.groupBy("item_id", "doc_id").agg(best.alias("p")).select("item_id", "doc_id", "p.start", "p.end")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Upsert: of rows with one key the last."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")
