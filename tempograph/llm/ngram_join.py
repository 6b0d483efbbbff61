"""N-gram Jaccard join by prefix trees, cut into sub-trees by the shingles of the sets' prefixes.

A document is the set of its distinct 5-word shingles (64-bit hashes). All sets are ordered by one global order: shingles
that many sets share come last, by how many do, the others by hash. Two sets of Jaccard similarity t or more then share a shingle among the
first n - ceil(t n) + 1 of each, their prefixes. A tree of all whole sets would lie in one task, and one for each shingle, with
whole sets, would be many times the input. So the tree is cut: the sub-tree of a shingle holds, of each set that has it in its
prefix, the path that follows: the next DEPTH shingles of the prefix that any other set has, with their places. Sub-trees are
dealt to tasks by their shingle. There sets walk their own sub-tree: a run of shingles that all paths below a node share is compared
once, the overlap so far is shared by all of them, and a subtree is left as soon as the overlap and the rest of both sets, by their
lengths and places, can't reach the bound. What remains are partners; they are verified exactly, by a tree of the whole sets of a
probe's partners, walked in the same way.

Work is linear in the text: one pass for set classes and frequent shingles, one for the prefixes, and one shuffle of the prefix
rows. Groups of copies never make all pairs: equal sets are one class; first only the most central sets of a sub-tree walk it, so that sets
get a leader and components; then all sets walk, past those of their own component.
Prefix rows go to partitions by shingle, and frequent shingles are last in the order, so that they are in few prefixes; where pairs
across components are made, the rows of a frequent shingle are dealt to several tasks. Large components are broadcast to their
classes, so that none of them lies in one task.

Nulls and texts without words have no shingle: n_shingles 0, component_id is the own doc_id. A null doc_id gives component_id
null unless its text's component holds an id. Repeated rows give a row each. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table, tidy

#: Most frequent shingles that are broadcast (8 bytes each), and the count from which a shingle may be one.
MAX_FREQUENT, FREQUENT = 1_000_000, 8
#: Up to so many rows of two ids (16 bytes) are broadcast; larger tables are joined by shuffle.
MAX_BROADCAST_ROWS = 2_000_000
#: Bytes of text that are hashed at once.
SLICE = 1 << 20
#: Shingles of a path in a sub-tree.
DEPTH = 16
#: Partners of a set that are verified in one trie, and shingles of a shared run that are looked up at once.
PIECE, STEP = 64, 32
#: Rows of one shingle or component beyond which they are dealt to several tasks.
BLOCK, MAX_GROUPS = 4096, 100_000

_MULTIPLIER, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20_000).integers(1, 1 << 64, 256, np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z are hashed as a-z
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def _power(n: int) -> list[np.ndarray]:
    """The first n powers of an odd multiplier, and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        k = 0x2545F4914F6CDD1D
        for i, base in enumerate((k, pow(k, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def _word_hashes(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and first bytes of the words of UTF-8 bytes, in which texts begin at firsts."""
    n = len(data)
    space = _SPACE[data]
    begin = ~space
    stop = begin.copy()
    begin[1:] &= space[:-1]
    stop[:-1] &= space[1:]
    inner = firsts[(firsts > 0) & (firsts < n)]
    begin[inner] = ~space[inner]
    stop[inner - 1] = ~space[inner - 1]
    b, e = np.flatnonzero(begin), np.flatnonzero(stop)
    up, down = _power(n)
    v = _VALUE[data] * up[:n]
    total = np.cumsum(v, dtype=np.uint64)
    h = (total[e] - total[b] + v[b]) * down[b] + (e - b).astype(np.uint64) * _LENGTH
    return _mix(h), b


def _sorted_set(h: np.ndarray) -> np.ndarray:
    h.sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    return h[keep]


def _shingles(w: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h *= _MULTIPLIER
        h += w[i : len(w) - k + 1 + i]
    return _mix(h)


def _long_text(data: np.ndarray) -> np.ndarray:
    """Word hashes of one text, in pieces cut at white space."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_word_hashes(data[at:end], np.zeros(1, np.int64))[0])
        at = end
    return np.concatenate(parts)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the ascending distinct 64-bit hashes of its word shingles; none for null."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        if offsets[hi] - offsets[lo] > SLICE:
            w = _long_text(data[offsets[lo] : offsets[hi]])
            edges = np.array([0, len(w)])
        else:
            firsts = offsets[lo:hi] - offsets[lo]
            w, b = _word_hashes(data[offsets[lo] : offsets[hi]], firsts)
            edges = np.append(np.searchsorted(b, firsts), len(w))
        all_h = _shingles(w, width) if len(w) >= width else w[:0]
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if y - x >= width:
                yield _sorted_set(all_h[x : y - width + 1].copy())
            else:
                yield _shingles(w[x:y], y - x) if y > x else w[:0]
        lo = hi


def _rarity(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
    """Rarity classes of ascending shingles, 0 for those that aren't frequent; None if none is."""
    tokens, classes = frequent
    if not len(tokens) or not len(s):
        return None
    at = np.searchsorted(tokens, s)
    at[at == len(tokens)] = 0
    rarity = np.where(tokens[at] == s, classes[at], 0)
    return rarity if rarity.any() else None


def _prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], percent: int) -> np.ndarray:
    """The first shingles in the global order: by rarity class (of those that are frequent), then by hash."""
    rarity = _rarity(s, frequent)
    if rarity is not None:
        s = s[np.argsort(rarity, kind="stable")]
    n = len(s)
    return s[: n - (percent * n + 99) // 100 + 1]


def global_order(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles as numbers that ascend in the global order: rarity class in the high six bits, then 58 bits of the hash."""
    rarity = _rarity(s, frequent)
    out = s >> np.uint64(6)
    if rarity is not None:
        out |= np.minimum(rarity, 63).astype(np.uint64) << np.uint64(58)
        out.sort()
    return out


def trie_overlaps(probe: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Overlap of probe with each set, all ascending in one order; -1 where it can't reach the bound.

    The sets are walked as a trie. A run of shingles that all sets below a node share is looked up in the probe when the walk comes
    to it, once for all of them; a set leaves as soon as its overlap so far and what remains of both can't reach the bound.
    """
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    n, out = len(probe), [-1] * len(sets)
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    need = -(-percent * (n + sizes) // (100 + percent))
    stack = [(0, len(order), 0, 0)]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        first, end = sets[order[lo]], sets[order[hi - 1]]
        m = min(len(first), len(end))
        same = first[depth:m] == end[depth:m]
        reach = depth + (int(same.argmin()) if len(same) and not same.all() else len(same))
        behind = n
        while depth < reach:  # the shared run in steps, so that sets without a chance leave early
            step = first[depth : min(reach, depth + STEP)]
            at = np.searchsorted(probe, step)
            overlap += int((probe[np.minimum(at, n - 1)] == step).sum())
            depth += len(step)
            behind = n - int(np.searchsorted(probe, step[-1], "right"))
            if (overlap + np.minimum(sizes[lo:hi] - depth, behind) < need[lo:hi]).all():
                break
        if depth < reach or (overlap + np.minimum(sizes[lo:hi] - reach, behind) < need[lo:hi]).all():
            continue
        while lo < hi and sizes[lo] == reach:
            if overlap >= need[lo]:
                out[order[lo]] = overlap
            lo += 1
        while lo < hi:
            child = lo + 1
            token = sets[order[lo]][reach]
            if hi - lo > 1 and sets[order[hi - 1]][reach] == token:
                child = hi
            while child < hi and sets[order[child]][reach] == token:
                child += 1
            stack.append((lo, child, reach, overlap))
            lo = child
    return out


def _classes(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, key of the row, n, class of its set; kind 1: a shingle and the number of distinct sets that a task saw it in, from two on."""
    names = ["kind", "doc_id", "key", "n", "cls", "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen, held, size = set(), [], 0

        def counts() -> pa.RecordBatch:
            tokens = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            n = np.diff(np.append(edge, len(tokens)))
            tokens, n = tokens[edge[n > 1]], n[n > 1]
            k = len(tokens)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(n), pa.nulls(k, pa.int64()), pa.array(tokens.view(np.int64))], names)

        for batch in batches:
            ns, classes = [], []
            for s in shingle_sets(batch.column(1)):
                ns.append(len(s))
                cls = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                classes.append(cls)
                if cls is not None and cls not in seen:
                    seen.add(cls)
                    held.append(s)
                    size += len(s)
            k = len(ns)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(classes, pa.int64()), pa.nulls(k, pa.int64())], names)
            if size > 4_000_000:
                yield counts()
                held, size = [], 0
        if held:
            yield counts()

    return docs.mapInArrow(tidy(run), "kind int, doc_id long, key long, n long, cls long, token long")


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least FREQUENT sets, ascending, and their rarity classes; if there are more than MAX_FREQUENT, only the most frequent classes."""
    classed = cut(counts.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).select("token", F.log2("n").cast("int").alias("rarity")))
    sizes = {r[0]: r[1] for r in classed.groupBy("rarity").count().collect()}
    least = 0
    while sum(n for k, n in sizes.items() if k >= least) > MAX_FREQUENT:
        least += 1
    rows = classed.where(F.col("rarity") >= least).collect()
    tokens = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r[1] for r in rows], np.uint8)[order]


def _prefix_rows(docs: DataFrame, frequent, percent: int) -> DataFrame:
    """A row for each shingle in the prefix of each set; copies of a set that a task has met are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen, last = set(), frequent.value
        for batch in batches:
            tokens, ns, classes, places = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                if len(s) and (cls := xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)) not in seen:
                    seen.add(cls)
                    tokens.append(p := _prefix(s, last, percent))
                    ns.append(len(s))
                    classes.append(cls)
                    places.append(np.arange(len(p), dtype=np.int32))
            if tokens:
                k = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(classes, np.int64), k)), pa.array(np.repeat(np.array(ns, np.int32), k)), pa.array(np.concatenate(places))], ["token", "cls", "n", "pos"])

    return docs.mapInArrow(tidy(run), "token long, cls long, n int, pos int")


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Tables whose rows of one first column are whole, from batches sorted by it."""
    rest = None
    for batch in batches:
        cols = {n: _unpacked(batch.column(i), np.uint32 if n == "path" else np.uint16) if n in ("path", "steps") else batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
        if rest is not None:
            cols = {n: np.concatenate([rest[n], cols[n]]) for n in names}
        key = cols[names[0]]
        if not len(key):
            continue
        at = int(np.searchsorted(key, key[-1], "left"))
        if at:
            yield {n: c[:at] for n, c in cols.items()}
        rest = {n: c[at:] for n, c in cols.items()}
    if rest is not None and len(rest[names[0]]):
        yield rest


def _has_partner(n: np.ndarray, pos: np.ndarray, group: np.ndarray, percent: int) -> np.ndarray:
    """Whether the smallest other set of the group that may match lets a common shingle be at this place; rows are sorted by group and n."""
    key = group * (1 << 32) + n
    at = np.searchsorted(key, group * (1 << 32) + -(-percent * n // 100))
    own = np.arange(len(n))
    at = np.where(at == own, own + 1, at)
    inside = at < len(n)
    at[~inside] = 0
    inside &= (group[at] == group) & (100 * np.minimum(n[at], n) >= percent * np.maximum(n[at], n))
    need = -(-percent * (n + n[at]) // (100 + percent))
    return inside & (pos <= n - need)


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of shingles that two classes or more have, and how many do; may: whether their place allows a partner of any size at hand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["token", "n", "cls", "pos"]):
            token, cls = t["token"], t["cls"]
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])  # repeats come from copies in several tasks
            t = {k: v[fresh] for k, v in t.items()}
            edge = np.flatnonzero(np.append(True, t["token"][1:] != t["token"][:-1]))
            length = np.diff(np.append(edge, len(t["token"])))
            many = np.repeat(length > 1, length)
            may = _has_partner(t["n"][many].astype(np.int64), t["pos"][many].astype(np.int64), np.repeat(np.arange(len(edge)), length)[many], percent)
            df = np.repeat(length, length)[many]
            yield pa.RecordBatch.from_arrays([pa.array(t[k][many]) for k in ("token", "n", "cls", "pos")] + [pa.array(df), pa.array(may)], ["token", "n", "cls", "pos", "df", "may"])

    sorted_rows = rows.select("token", "n", "cls", "pos").repartition("token").sortWithinPartitions("token", "n", "cls")
    return sorted_rows.mapInArrow(tidy(run), "token long, n int, cls long, pos int, df long, may boolean")


def _with_paths(rows: DataFrame, frequent, percent: int) -> DataFrame:
    """The rows that may have a partner, each with the path that follows in its class, and the class's order: the more central, the smaller.

    Rows of a class are those of one set's prefix. Paths have DEPTH entries, those beyond the end are 0: numbers of the global order,
    of which 32 bits are kept, and steps between places, of which 16 bits are. Both can only raise bounds, so no partner is lost.
    What near copies have changed is rare and so first in their order; the text that they come from has shared shingles only. So a
    class is the more central, the more classes share the shingles of its prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "pos", "token", "n", "df", "may"]
        for t in _runs(batches, names):
            k, last = len(t["cls"]), frequent.value
            token = t["token"].view(np.uint64)
            order = np.argsort(token)
            rarity = _rarity(token[order], last)
            number = np.zeros(k, np.uint32)
            number[order] = np.maximum((token[order] >> np.uint64(38)).astype(np.uint32) | (np.minimum(rarity, 63).astype(np.uint32) << np.uint32(26) if rarity is not None else np.uint32(0)), np.uint32(1))
            first, end = np.searchsorted(t["cls"], t["cls"], "left"), np.searchsorted(t["cls"], t["cls"], "right")
            shared = np.append(0, np.cumsum(np.where(t["may"], t["df"], 0)))
            prefix = t["n"].astype(np.int64) - -(-percent * t["n"].astype(np.int64) // 100) + 1
            central = -(shared[end] - shared[first]) / prefix
            step = np.append(0, np.minimum(np.diff(t["pos"].astype(np.int64)), 65535))  # from the row before, of the same class where it is used
            at = np.flatnonzero(t["may"])
            place = at[:, None] + 1 + np.arange(DEPTH)[None, :]
            inside = place < end[at][:, None]
            place[~inside] = 0
            path, steps = np.where(inside, number[place], 0).astype(np.uint32), np.where(inside, step[place], 0).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([*[pa.array(t[c][at]) for c in ("token", "n", "cls", "pos")], pa.array(central[at]), pa.array(prefix[at]), _packed(path), _packed(steps)], ["token", "n", "cls", "pos", "order", "prefix", "path", "steps"])

    met = rows.select("cls", "pos", "token", "n", "df", "may").repartition("cls").sortWithinPartitions("cls", "pos")
    return met.mapInArrow(tidy(run), "token long, n int, cls long, pos int, order double, prefix long, path binary, steps binary")


def _packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    m = np.ascontiguousarray(m)
    offsets = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] * m.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def _unpacked(c: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), kind).reshape(len(c), DEPTH)


class SubTree:
    """The paths of the sets that have one shingle, sorted, so that a node of the tree is a range of them."""

    def __init__(self, n: np.ndarray, pos: np.ndarray, path: np.ndarray, steps: np.ndarray, percent: int) -> None:
        self.order = np.lexsort(path.T[::-1])
        self.at = np.argsort(self.order)
        self.n, self.path, self.percent = n[self.order].astype(np.int64), path[self.order], percent
        self.length = (self.path > 0).sum(1)
        gone = np.cumsum(np.concatenate([pos[self.order, None].astype(np.int64), steps[self.order].astype(np.int64)], axis=1), axis=1)
        self.rest = self.n[:, None] - gone - 1  # of the set, behind each node

    def partners(self, i: int, ok: np.ndarray) -> np.ndarray:
        """Which of the sets marked in ok may reach the bound with set i; sets are numbered as they were given."""
        ok, i = ok[self.order], int(self.at[i])
        n, path, behind = int(self.n[i]), self.path[i], self.rest[i].tolist()
        need = -(-self.percent * (n + self.n) // (100 + self.percent))
        ok &= 1 + np.minimum(self.rest[:, 0], behind[0]) >= need
        if not ok.any():
            return np.empty(0, np.int64)
        own = path[: self.length[i]].tolist()
        before, out, stack = np.append(0, np.cumsum(ok)), [], [(0, len(ok), 0, 1, 0)]
        while stack:
            lo, hi, depth, overlap, k = stack.pop()
            if before[lo] == before[hi]:
                continue
            first, last = self.path[lo], self.path[hi - 1]
            while depth < DEPTH and first[depth] == last[depth] and first[depth]:  # the run that all paths below share
                number = int(first[depth])
                k = bisect_left(own, number, k)
                if k < len(own) and own[k] == number:
                    overlap, k = overlap + 1, k + 1
                depth += 1
            alive = ok[lo:hi] & (overlap + np.minimum(self.rest[lo:hi, depth], behind[k]) >= need[lo:hi])
            if not alive.any():
                continue
            ended = int(np.searchsorted(self.length[lo:hi] > depth, True)) if depth < DEPTH else hi - lo
            out.append(lo + np.flatnonzero(alive[:ended]))
            if lo + ended < hi:
                of = self.path[lo + ended : hi, depth]
                edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                stack += [(lo + ended + a, lo + ended + b, depth, overlap, k) for a, b in zip(edges[:-1], edges[1:])]
        return self.order[np.concatenate(out)] if out else np.empty(0, np.int64)


def _leaders(rows: DataFrame, percent: int, most: int = 3) -> DataFrame:
    """cls, other: each class with the most central class of the sub-trees that it meets it in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["token", "order", "cls", "n", "pos", "path", "steps"]):
            edge = np.flatnonzero(np.append(True, t["token"][1:] != t["token"][:-1])).tolist() + [len(t["token"])]
            made = []
            for lo, hi in zip(edge[:-1], edge[1:]):
                if hi - lo < 2:
                    continue
                tree, open_ = SubTree(*(t[c][lo:hi] for c in ("n", "pos", "path", "steps")), percent), np.ones(hi - lo, bool)
                for _ in range(most):  # the first set of a sub-tree that has no leader walks it
                    if not open_.any():
                        break
                    i = int(open_.argmax())
                    open_[i] = False
                    got = tree.partners(i, open_)
                    open_[got] = False
                    made.append((lo + got, np.full(len(got), lo + i)))
            if made:
                got, lead = (np.concatenate(c) for c in zip(*made))
                yield pa.RecordBatch.from_arrays([pa.array(t["cls"][got]), pa.array(t["cls"][lead])], ["cls", "other"])

    work = rows.select("token", "order", "cls", "n", "pos", "path", "steps")
    met = work.repartition("token").sortWithinPartitions("token", "order", "cls").mapInArrow(tidy(run), "cls long, other long")
    return met.groupBy("cls", "other").count().groupBy("cls").agg(F.max_by("other", F.struct("count", "other")).alias("other"))


def _with_group(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows left-joined with one row a key; keys of many rows are broadcast, so no task gets a large group.

    A key is large from 1 / MAX_GROUPS of all rows on (and BLOCK at least, where there are few), so at most MAX_GROUPS are. In the
    join by shuffle, rows of large keys and of none are spread by a salt that no group has.
    """
    sizes = rows.groupBy(key).count()
    n = rows.count()
    large = cut(groups.join(sizes.where(F.col("count") > max(min(BLOCK, n // 1000), n // MAX_GROUPS)), key).drop("count"))
    value = [c for c in groups.columns if c != key]
    spread = 1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1000))
    placed = rows.join(F.broadcast(large.withColumn("_large", F.lit(True)).withColumnsRenamed({c: f"_{c}" for c in value})), key, "left")
    placed = placed.withColumn("_salt", F.when(F.col("_large").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(spread))
    zero = F.pmod(F.xxhash64(key), F.lit(1))  # not a constant: a join on one would be one on the key alone
    joined = placed.join(groups.withColumn("_salt", zero), [key, "_salt"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_{c}", c).alias(c) for c in value])


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows of shingles of two components or more, by parts (deal) of a shingle in which each two rows meet in exactly one.

    A shingle of BLOCK rows or fewer is one part. Of a larger one, rows have a chunk each, and every two chunks are a part.
    """
    mixed = rows.groupBy("token").agg((F.min("comp") != F.max("comp")).alias("mixed"), F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")).where("mixed").select("token", "chunks")
    dealt = rows.join(_sized(cut(mixed)), "token").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    parts = dealt.withColumn("other", other)
    deal = F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")
    return parts.select("token", deal.cast("int").alias("deal"), "n", "cls", "pos", "comp", F.when(F.col("chunks") == 1, -1).otherwise(F.col("chunk")).alias("chunk"), "path", "steps")


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs that lie in two components and stay when the sets of a sub-tree walk it, each past those that come after it.

    A pair of the bound is found in the sub-tree of its first common shingle at the latest. Sub-trees come by parts; in a part of two
    chunks, sets of one chunk don't meet, as they do in the chunk's own part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "other"]
        for t in _runs(batches, ["token", "deal", "n", "cls", "pos", "comp", "chunk", "path", "steps"]):
            token, deal = t["token"], t["deal"]
            edge = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (deal[1:] != deal[:-1]))).tolist() + [len(token)]
            made, size = [], 0
            for lo, hi in zip(edge[:-1], edge[1:]):
                n, cls, pos, comp, chunk, path, steps = (t[c][lo:hi] for c in ("n", "cls", "pos", "comp", "chunk", "path", "steps"))
                if (comp == comp[0]).all():
                    continue
                apart = chunk if (chunk != chunk[0]).any() else np.arange(hi - lo)
                tree, later = SubTree(n, pos, path, steps, percent), np.arange(hi - lo)
                for i in range(hi - lo - 1):
                    got = tree.partners(i, (later > i) & (comp != comp[i]) & (apart != apart[i]))
                    if len(got):
                        made.append((np.minimum(cls[got], cls[i]), np.maximum(cls[got], cls[i])))
                        size += len(got)
                        if size > 100_000:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names)
                            made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], names)

    met = rows.repartition("token", "deal").sortWithinPartitions("token", "deal", "n", "cls").mapInArrow(tidy(run), "cls long, other long")
    return met.distinct()


def _sets(rows: DataFrame) -> DataFrame:
    """cls, shingles from rows (cls, text), for the texts that are of the class (all, unless keys collide)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            kept = [(c, s) for c, x in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))) if xxhash.xxh3_64_intdigest(s := x.tobytes()) - (1 << 63) == c]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in kept], pa.int64()), pa.array([s for _, s in kept], pa.binary())], ["cls", "shingles"])

    return rows.mapInArrow(tidy(run), "cls long, shingles binary")


def _sized(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it is small."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_ROWS else ids


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, frequent, percent: int) -> DataFrame:
    """The pairs (written ones) whose similarity reaches the bound; texts are read again for their classes only.

    The sets of a probe's partners meet the probe in pieces of about PIECE, so a probe of many partners is in many tasks.
    """
    probes = pairs.groupBy("other").agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
    dealt = cut(pairs.join(probes, "other").withColumn("piece", F.pmod(F.xxhash64("cls"), F.col("pieces"))).select("cls", "other", "piece"))
    asked = dealt.select(F.col("other").alias("cls"), F.col("other").alias("probe"), "piece", F.lit(0).alias("part")).distinct().union(dealt.select("cls", F.col("other").alias("probe"), "piece", F.lit(1).alias("part")))
    wanted = cut(asked.select("cls").distinct().join(reps, "cls").select("cls", "key"))
    sets = _sets(docs.join(_sized(wanted), "key").select("cls", "text"))
    few = 2 * dealt.count() <= MAX_BROADCAST_ROWS
    met = sets.join(F.broadcast(asked) if few else asked, "cls").select("probe", "piece", "part", "cls", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, held = None, None, []

        def found() -> pa.RecordBatch:
            sets = [x for _, x in held]
            good = [c for (c, _), n in zip(held, trie_overlaps(probe, sets, percent) if probe is not None else [-1] * len(sets)) if n >= 0]
            return pa.RecordBatch.from_arrays([pa.array(good, pa.int64()), pa.array([key[0]] * len(good), pa.int64())], ["cls", "other"])

        for batch in batches:
            for lead, piece, part, cls, x in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (lead, piece):
                    if held:
                        yield found()
                    key, probe, held = (lead, piece), None, []
                x = global_order(np.frombuffer(x, np.uint64), frequent.value)
                if part == 0:
                    probe = x
                else:
                    held.append((cls, x))
                    if len(held) >= 2 * PIECE:
                        yield found()
                        held = []
        if held:
            yield found()

    return met.repartition("probe", "piece").sortWithinPartitions("probe", "piece", "part").mapInArrow(tidy(run), "cls long, other long").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node reachable by links (cls, other); alternating large and small stars."""
    edges = cut(links.select(F.greatest("cls", "other").alias("u"), F.least("cls", "other").alias("v")).where("u > v").distinct())
    state = None
    while True:
        # Large star: larger neighbours of each node go to its smallest neighbour. Small star: the node and its smaller ones do.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v")
        edges = cut(small.distinct())
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp"))
        state = now


def _row_key() -> Column:
    """A key of doc_id and text; of rows that have none, rows are told apart by their text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), F.col("text").cast("string"))


def _members(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, key, n_shingles, component_id, comp (null without shingles) of each row."""
    spark: SparkSession = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key().alias("key"))
    seen = cut(_classes(docs))
    members = seen.where("kind = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), "cls")
    frequent = spark.sparkContext.broadcast(_frequent(seen.where("kind = 1").select("token", "n")))
    rows = cut(_with_paths(_meet(_prefix_rows(docs, frequent, percent), percent), frequent, percent))
    reps = members.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    comps = cut(components(_verify(cut(_leaders(rows, percent)), docs, reps, frequent, percent)))
    of = lambda c: F.coalesce("comp", c)
    labelled = rows.join(_sized(comps.withColumnRenamed("node", "cls")), "cls", "left").select("token", "n", "cls", "pos", of("cls").alias("comp"), "path", "steps")
    more = cut(_verify(cut(_across(_dealt(labelled), percent)), docs, reps, frequent, percent))
    named = lambda df, c: df.join(comps.withColumnRenamed("node", c), c, "left").withColumn(c, of(c)).drop("comp")
    over = components(named(named(more, "cls"), "other"))
    classes = reps.join(comps.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "doc_id", of("cls").alias("first"))
    classes = cut(_with_group(classes, over.withColumnRenamed("node", "first"), "first").select("cls", "doc_id", of("first").alias("comp")))
    least = classes.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = _with_group(classes, least, "comp").select("cls", "component_id", "comp")
    return _with_group(members, cut(by_class), "cls").select("doc_id", "key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "comp")


def near_duplicate_components(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity percent/100 or more)."""
    return _members(docs, percent).select("doc_id", "n_shingles", "component_id")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(read_table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest doc_id (null last), of several texts that of the smallest key.

    Rows without shingles stay, each doc_id and text once.
    """
    found = cut(_members(docs, 75).groupBy("comp", "key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    first = found.where("comp is not null").groupBy("comp").agg(F.min(order).getField("key").alias("first"))
    placed = _with_group(found, first, "comp").select("key", F.coalesce(F.col("key") == F.col("first"), F.lit(True)).alias("stays"), "rows")
    away = cut(placed.where("not stays or rows > 1"))
    keyed = docs.withColumn("_key", _row_key())
    kept = keyed.join(away.select(F.col("key").alias("_key")), "_key", "left_anti").select(docs.columns)
    repeated = keyed.join(away.where("stays").select(F.col("key").alias("_key")), "_key", "left_semi")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.unionByName(repeated.groupBy("_key").agg(F.min(others).alias("row")).select("row.*"))
