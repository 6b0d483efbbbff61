"""SentencePiece-style encoding with seeded merge-dropout, and lossless decoding.

The vocabulary and the merge order (scores) are those of a public merge-type model. A text is split where no piece can cross: at
line ends and before runs of spaces. In each part an agenda gives the best candidate merge, leftmost on ties; a candidate is skipped
if a hash keyed by seed, document (its doc_id, and the number of its copy after mixing), both pieces and place in the text falls
below the rate. So each occurrence of a word has its own draws, and every run the same ones. Only the merges without dropout of
a part are remembered: an occurrence that passes all their draws is segmented so, any other is merged with its own draws.
Characters without a piece, and U+2581 itself, become byte pieces, so decoding gives every text back.

A null text is encoded as no ids and decoded as null; an empty text as no ids. A null doc_id draws by its text. Repeated rows give
equal rows, unless a column numbers them. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RATE, SEED = 0.1, 42
SPACE = "▁"
_PART = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_MASK, _NONE, _END, _SPREAD = (1 << 64) - 1, 1 << 60, 0xFFFFF, 0x9E3779B97F4A7C15
#: Parts whose merges without dropout are remembered; occurrences at once; widths of the tables in which parts are merged together.
KNOWN, AT_ONCE, WIDTHS = 320_000, 1 << 16, (6, 9, 13, 18, 28)


class Pieces:
    """A model's pieces, as plain Python values that can be broadcast (bounded by the vocabulary)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids, self.ids, self.scores, self.bytes_of = [0] * 256, {}, {}, []
        for i in range(model.vocab_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[p], self.scores[p] = i, model.get_score(i)
                self.bytes_of.append(p.replace(SPACE, " ").encode())


def _draws(pair: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Encoder.skips' number of 32 bits for many candidates."""
    h = (pair.astype(np.uint64) ^ key) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)


class _Rows:
    """A table that grows."""

    def __init__(self, columns: int, kind: type = np.int64) -> None:
        self.room, self.rows = np.empty((1024, columns), kind), np.empty((0, columns), kind)

    def add(self, rows: np.ndarray) -> None:
        n = len(self.rows)
        if n + len(rows) > len(self.room):
            self.room = np.empty((2 * (n + len(rows)), rows.shape[1]), self.room.dtype)
            self.room[:n] = self.rows
        self.room[n : n + len(rows)] = rows
        self.rows = self.room[: n + len(rows)]


class Encoder:
    def __init__(self, pieces: Pieces, seed: int = SEED, rate: float = RATE) -> None:
        self.pieces, self.seed, self.below = pieces, seed, int(rate * (1 << 32))
        self.texts = {i: p for p, i in pieces.ids.items()}
        order = {p: r for r, p in enumerate(sorted(pieces.ids, key=lambda p: -pieces.scores[p]))}
        self.merges: dict[int, int] = {}  # pair of ids -> place in the merge order and id of the merged piece, in one number
        for p, i in pieces.ids.items():
            for k in range(1, len(p)):
                if p[:k] in pieces.ids and p[k:] in pieces.ids:
                    self.merges[pieces.ids[p[:k]] << 20 | pieces.ids[p[k:]]] = order[p] << 20 | i
        self.chars = {c: i for c, i in pieces.ids.items() if len(c) == 1 and c != SPACE} | {" ": pieces.ids[SPACE]}
        self.known: dict[str, int] = {}  # rows of parts in the table of merges without dropout
        self.char_ids, self.all_chars = None, frozenset(self.chars)

    def key(self, stream: int) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(f"{self.seed}:{stream}")

    def skips(self, key: int, pair: int, at: int) -> bool:
        h = ((pair ^ key) * 0x9E3779B97F4A7C15 + at * 0xC2B2AE3D27D4EB4F) & _MASK
        return (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & _MASK) >> 32 < self.below

    def part(self, text: str, key: int, start: int = 0) -> list[int]:
        """Ids of one part, in which a space stands for U+2581; its first character is at start."""
        ids = [self.chars.get(c, -1) for c in text]
        if len(ids) <= 40:
            ids, at = self._merge_short(ids, key, start)
        else:
            ids, at = self._merge_long(ids, key, start)
        if min(ids) >= 0:
            return ids
        return self._with_bytes(text, ids, at)

    def _merge_short(self, ids: list[int], key: int, start: int = 0) -> tuple[list[int], list[int]]:
        """The agenda of a short part is a list: its least entry is found by min."""
        find, below = self.merges.get, self.below
        agenda = [find(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])]
        at = list(range(len(ids)))
        while agenda:
            best = min(agenda)
            if best == _NONE:
                break
            i = agenda.index(best)
            if below:
                h = (((ids[i] << 20 | ids[i + 1]) ^ key) * 0x9E3779B97F4A7C15 + (start + at[i]) * 0xC2B2AE3D27D4EB4F) & _MASK
                if (((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & _MASK) >> 32 < below:
                    agenda[i] = _NONE
                    continue
            ids[i] = new = best & 0xFFFFF
            del ids[i + 1], at[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = find(new << 20 | ids[i + 1], _NONE)
            if i:
                agenda[i - 1] = find(ids[i - 1] << 20 | new, _NONE)
        return ids, at

    def _merge_long(self, ids: list[int], key: int, start: int = 0) -> tuple[list[int], list[int]]:
        """The agenda of a long part is a heap, its symbols a linked list."""
        merges, n, below = self.merges, len(ids), self.below
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(merges[p], i, i + 1, p) for i in range(n - 1) if (p := ids[i] << 20 | ids[i + 1]) in merges]
        heapq.heapify(agenda)
        while agenda:
            best, i, j, pair = heapq.heappop(agenda)
            if right[i] != j or ids[i] == -2 or ids[i] << 20 | ids[j] != pair or (below and self.skips(key, pair, start + i)):
                continue
            ids[i], ids[j] = best & 0xFFFFF, -2
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (p := ids[i] << 20 | ids[k]) in merges:
                    heapq.heappush(agenda, (merges[p], i, k, p))
            if (h := left[i]) >= 0 and (p := ids[h] << 20 | ids[i]) in merges:
                heapq.heappush(agenda, (merges[p], h, i, p))
        at, i = [], 0
        while i < n:
            at.append(i)
            i = right[i]
        return [ids[i] for i in at], at

    def _table(self) -> None:
        """The merges as an open hash table in numpy, and the ids of characters."""
        self.bits = 19
        size = 1 << self.bits
        self.slots, self.values = np.full(size, -1, np.int64), np.full(size, _NONE, np.int64)
        for pair, value in self.merges.items():
            at = (pair * _SPREAD & _MASK) >> (64 - self.bits)
            while self.slots[at] >= 0:
                at = (at + 1) % size
            self.slots[at], self.values[at] = pair, value
        self.char_ids = np.full(0x110000, -1, np.int64)
        for c, i in self.chars.items():
            self.char_ids[ord(c)] = i

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left << 20 | right
        at = ((pair.view(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(64 - self.bits)).view(np.int64)
        got = self.slots.take(at)
        hit = got == pair
        out = np.where(hit, self.values.take(at), _NONE)
        again = np.flatnonzero(~hit & (got >= 0))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[again]]
            hit = got == pair[again]
            out[again[hit]] = self.values[at[again[hit]]]
            again = again[~hit & (got >= 0)]
        return out

    def _merge_many(self, parts: list[str], keys: np.ndarray, starts: np.ndarray, width: int, below: int, steps: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As _merge_short for many parts of at most width known characters at once: each round takes the least entry of every agenda.

        Gives all ids in a row and how many each part has. To steps go the part, pair and place of every merge, by rounds.
        """
        n, none = len(parts), np.int64(_NONE)
        lengths = np.fromiter(map(len, parts), np.int64, n)
        ids = self.char_ids[np.array(parts, f"U{width}").view(np.uint32).reshape(n, width)]
        ids[np.arange(width) >= lengths[:, None]] = _END
        agenda = np.full((n, width), none)
        agenda[:, :-1] = self._find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        symbols = (ids << 5 | np.arange(width)).ravel()  # the id and the place in the part
        agenda = agenda.ravel()
        rows, columns = np.arange(n), np.arange(width - 1)
        while len(rows):
            a = agenda.reshape(n, width).take(rows, 0)
            i = a.argmin(1)
            best = a[np.arange(len(rows)), i]
            alive = best < none
            rows, i, best = rows[alive], i[alive], best[alive]
            r, k = rows, rows * width + i
            if below or steps is not None:
                pair, place = symbols[k] >> 5 << 20 | symbols[k + 1] >> 5, starts[rows] + (symbols[k] & 31)
            if steps is not None:
                steps.append((rows, pair, place))
            if below:
                skip = _draws(pair, keys[rows], place) < below
                agenda[k[skip]] = none
                keep = ~skip
                r, k, i, best = r[keep], k[keep], i[keep], best[keep]
            new = best & 0xFFFFF
            symbols[k] = new << 5 | symbols[k] & 31
            to = r[:, None] * width + columns
            take = to + (columns > i[:, None])
            symbols[to], agenda[to] = symbols.take(take), agenda.take(take)
            symbols[r * width + width - 1], agenda[r * width + width - 1] = _END << 5, none
            agenda[k] = self._find(new, symbols[k + 1] >> 5)
            inner = i > 0
            k, new = k[inner] - 1, new[inner]
            agenda[k] = self._find(symbols[k] >> 5, new)
        some = symbols >> 5 != _END
        return (symbols[some] >> 5).astype(np.int32), some.reshape(n, width).sum(1)

    def _with_bytes(self, text: str, ids: list[int], at: list[int]) -> list[int]:
        out = []
        for i, a in zip(ids, at):
            out += [i] if i >= 0 else [self.pieces.byte_ids[b] for b in text[a].encode("utf-8", "surrogatepass")]
        return out

    def _by_width(self, parts: list[str], keys: np.ndarray, starts: np.ndarray, below: int, steps: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_merge_many by tables of WIDTHS: all ids, where the ids of each part begin, and how many they are."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        begin, count, flat, size, low = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), [np.empty(0, np.int32)], 0, 0
        for width in WIDTHS:
            some = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(some):
                its: list | None = None if steps is None else []
                ids, n = self._merge_many([parts[x] for x in some.tolist()], keys[some], starts[some], width, below, its)
                flat.append(ids)
                begin[some], count[some] = size + np.cumsum(n) - n, n
                size += len(ids)
                if steps is not None:
                    steps += [(some[r], pair, place) for r, pair, place in its]
        return np.concatenate(flat), begin, count

    def _clear(self) -> None:
        # Ids of all known parts, the pairs and places of their merges; of each part where both begin and how many they are.
        self.known, self.flat, self.merged, self.spans = {}, _Rows(1, np.int32), _Rows(1), _Rows(4)

    def learn(self, parts: set[str]) -> None:
        """The merges without dropout of parts that aren't known yet; nothing that was drawn is kept."""
        plain, at = [], len(self.spans.rows)
        for p in parts:
            if len(p) <= WIDTHS[-1] and self.all_chars.issuperset(p):
                self.known[p] = at + len(plain)
                plain.append(p)
            else:
                self.known[p] = -1  # merged anew wherever it occurs
        steps: list = []
        zero = np.zeros(len(plain), np.int64)
        flat, begin, count = self._by_width(plain, zero.view(np.uint64), zero, 0, steps)
        part, pairs, places = (np.concatenate(x) for x in zip(*steps)) if steps else (zero[:0],) * 3
        order = np.argsort(part, kind="stable")
        n = np.bincount(part, minlength=len(plain))
        self.spans.add(np.stack([begin + len(self.flat.rows), count, np.cumsum(n) - n + len(self.merged.rows), n], 1))
        self.flat.add(flat[:, None])
        self.merged.add((pairs << 5 | places)[order, None])

    def _rows_of(self, parts: list[str]) -> np.ndarray:
        """The rows of parts in the table, after learning what is new."""
        if self.char_ids is None:
            self._table()
            self._clear()
        row = np.fromiter(map(self.known.get, parts, repeat(-2)), np.int64, len(parts))
        missing = np.flatnonzero(row == -2)
        if len(missing):
            new = {parts[x] for x in missing.tolist()}
            if len(self.known) + len(new) > KNOWN:
                self._clear()
                new, missing = set(parts), np.arange(len(parts))
            self.learn(new)
            row[missing] = [self.known[parts[x]] for x in missing.tolist()]
        return row

    def _occurrences(self, parts: list[str], keys: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of occurrences of parts, and how many each has.

        One whose merges without dropout all pass its own draws is as without dropout; any other is merged anew with its draws.
        """
        row = self._rows_of(parts)
        begin, count, first, n = (self.spans.rows.take(row, 0, mode="wrap").T if len(self.spans.rows) else np.zeros((4, len(row)), np.int64)).copy()
        n[row < 0] = 0
        again = np.zeros(len(parts), bool)
        if self.below:
            owner = np.repeat(np.arange(len(parts)), n)
            step = self.merged.rows[:, 0].take(np.arange(len(owner)) + np.repeat(first - np.cumsum(n) + n, n))
            again[owner[_draws(step >> 5, np.repeat(keys, n), np.repeat(starts, n) + (step & 31)) < self.below]] = True
        some = np.flatnonzero(again)
        flat, begin[some], count[some] = self._by_width([parts[x] for x in some.tolist()], keys[some], starts[some], self.below)
        known = self.flat.rows[:, 0]
        begin[some] += len(known)
        pool, size = [known, flat], len(known) + len(flat)
        for x in np.flatnonzero(row < 0).tolist():
            ids = np.array(self.part(parts[x], int(keys[x]), int(starts[x])), np.int32)
            pool.append(ids)
            begin[x], count[x] = size, len(ids)
            size += len(ids)
        return np.concatenate(pool).take(np.arange(count.sum()) + np.repeat(begin - np.cumsum(count) + count, count)), count

    def _encode(self, texts: list[str], keys: list[int], placed: bool) -> list[np.ndarray]:
        """Ids of texts by their keys; places are those in the text if placed, else those in each part."""
        parts = [_PART.findall(" " + t) if t else [] for t in texts]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = list(chain.from_iterable(parts))
        key = np.repeat(np.array(keys, np.uint64), size)
        starts = np.zeros(len(flat), np.int64)
        if placed and flat:
            length = np.fromiter(map(len, flat), np.int64, len(flat))
            starts = np.cumsum(length) - length
            starts -= np.repeat(starts[np.minimum(np.cumsum(size) - size, len(flat) - 1)], size)
        done = [self._occurrences(flat[x : x + AT_ONCE], key[x : x + AT_ONCE], starts[x : x + AT_ONCE]) for x in range(0, len(flat), AT_ONCE)]
        ids = np.concatenate([np.empty(0, np.int32), *(i for i, _ in done)])
        ends = np.append(0, np.cumsum(np.concatenate([np.empty(0, np.int64), *(n for _, n in done)])))[np.append(0, np.cumsum(size))]
        return [ids[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_all(self, texts: list[str], streams: list[int]) -> list[np.ndarray]:
        """Ids of texts by numbered keys and places in the parts: an equal part of one stream has equal ids."""
        return self._encode(texts, [self.key(s) for s in streams], False)

    def encode_documents(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of texts by their own keys and places in the text: each occurrence of a part has its own draws."""
        return self._encode(texts, keys, True)

    def encode(self, text: str, stream: int = 0) -> np.ndarray:
        return self.encode_all([text], [stream])[0]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the first space is the encoder's."""
        b = b"".join(map(self.pieces.bytes_of.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return b[1:]


_encoders: dict = {}


def _encoder(pieces, seed: int, rate: float) -> Encoder:
    """One encoder a worker process, so that parts stay known from task to task."""
    key = (seed, rate, len(pieces.ids), hash(frozenset(list(pieces.ids.items())[:2000])))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(pieces, seed, rate)
    return _encoders[key]


def key_of(doc_id: int | None, text: str | None, copy: int = 1, seed: int = SEED) -> int:
    """The key of a document's draws: of seed, copy and doc_id, or the text where that is null."""
    import xxhash

    return xxhash.xxh64_intdigest(f"{seed}:{copy}:{doc_id}" if doc_id is not None else f"{seed}:{copy}::{text or ''}".encode("utf-8", "surrogatepass"))


def encode_documents(docs: DataFrame, model: str = MODEL, seed: int = SEED, rate: float = RATE) -> DataFrame:
    """doc_id, stream (the key of the document's draws, as a signed number), n_tokens, ids, and whether the ids decode to the text.

    A column copy, if there, numbers the rows of one document, which have draws of their own.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, seed, rate)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # ids take several times the room of their text
                doc_ids, texts = batch.column(0)[at : at + 256], batch.column(1)[at : at + 256].to_pylist()
                keys = [key_of(i, t, c, seed) for i, t, c in zip(doc_ids.to_pylist(), texts, batch.column(2)[at : at + 256].to_pylist())]
                ids = encoder.encode_documents([t or "" for t in texts], keys)
                n = [len(i) for i in ids]
                same = [encoder.decode(i.tolist()) == (t or "") for i, t in zip(ids, texts)]
                values = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(n, pa.int64()), values, pa.array(same)], ["doc_id", "stream", "n_tokens", "ids", "decodes"])

    copy = F.col("copy").cast("long") if "copy" in docs.columns else F.lit(1).cast("long")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), copy.alias("copy"))
    return docs.mapInArrow(tidy(run), "doc_id long, stream long, n_tokens long, ids array<int>, decodes boolean")


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from ids; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value, SEED, RATE)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else encoder.decode(i) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text string")


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))
