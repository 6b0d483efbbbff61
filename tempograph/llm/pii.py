"""Personal data: base patterns, and a skip-chain conditional random field that adds what they miss.

The base finds e-mail addresses, IP addresses, card and phone numbers (leftmost, non-overlapping, each kind by itself). The field
has a node for each token with a digit or an @, and for names of addresses that the text has, alone or as `name at domain`; all
other tokens are surely outside. Chain edges link neighbouring nodes; skip
edges link each token to the next equal one, to similar ones (of its length, one half equal, at most two characters different) and
numbers to those that end in the same digits, whatever stands between digits, in the document, however far, so that edges grow
with the tokens and not with their square. Loopy sum-product messages, computed for all documents of a batch at once, make labels of
such tokens agree: digits of a phone number are marked where they recur without their prefix, and keys after `token =` are
found as secrets. Tokens in base spans are held at their label, and base spans are never changed.

The log-potentials are parameters (UNARY, CHAIN, SKIP). A null text is empty: no spans, the digest of the empty string. A null
doc_id is passed on; repeated rows give equal rows; an empty table an empty result. Rows are independent: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read_table, tidy

KINDS = ["email", "ip", "card", "phone", "secret"]
OUT = len(KINDS)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+")  # linear: tried at beginnings of words only
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_AT = re.compile(r"(?i)[\x20\x09-\x0D]+(?:at|@|\(at\)|\[at\]|\{at\})[\x20\x09-\x0D]+")
_KEYS = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|auth)[^\x20\x09-\x0D]*[\x20\x09-\x0D]*(?:[=:][\x20\x09-\x0D]*)?$")
_CORE = re.compile(r"[0-9A-Za-z](?:.*[0-9A-Za-z])?", re.S)
_LONG = re.compile(r"[0-9A-Za-z_-]{20,}+")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")

#: Log-potentials. Nodes: outside has 2; a base span holds its label; else what a token looks like.
UNARY = {"outside": 2.0, "base": 12.0, "at": 1.0, "dotted": 1.0, "digits": 0.8, "phone": 0.5, "key": 1.5, "named": 2.5}
#: Neighbours of one label; equal tokens of one label, or of equal digits; similar ones. One link to a base span decides.
CHAIN, SKIP, ALIKE = 0.5, 3.0, 2.6
ROUNDS = 8
#: Nodes from which on the documents at hand are labelled before more are added.
NODES = 100_000
#: Digits that numbers must share at their ends, and characters of which two may differ in similar tokens.
END, LIKE = 7, 8
#: Links by digits that a token gets at most: to base spans, and to others. Messages that are computed at once.
LINKS, STEP = 2, 200_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    if not _MARK.search(text):
        return []
    found = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", max(at + 1, end))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _unary(token: str, before: str, kind: int | None) -> list[float]:
    p = [0.0] * (OUT + 1)
    p[OUT] = UNARY["outside"]
    if kind is not None:
        p[kind] += UNARY["base"]
        return p
    n = sum("0" <= c <= "9" for c in token)
    if "@" in token[1:-1]:
        p[0] += UNARY["at"]
    if token.count(".") >= 3 and n >= 4:
        p[1] += UNARY["dotted"]
    if 13 <= n <= 19:
        p[2] += UNARY["digits"]
    if 6 <= n <= 15 and ("-" in token or "(" in token or token[0] == "+"):
        p[3] += UNARY["phone"]
    if len(token) >= 20 and any(_DIGIT.search(m[0]) and _LETTER.search(m[0]) for m in _LONG.finditer(token)):
        p[4] += UNARY["key"]
        if _KEYS.search(before):
            p[4] += UNARY["named"]
    return p


def _mail_parts(text: str, base: list[tuple[int, int, int]]) -> dict[str, dict[str, str]]:
    """Of each name before the @ of a base span, the addresses it is in by their domains, in order."""
    found: dict[str, dict[str, str]] = {}
    for s, k, e in base:
        if k == 0:
            mail = text[s:e].lower()
            name, _, domain = mail.partition("@")
            found.setdefault(name.strip("._%+-"), {}).setdefault(domain, mail)
    found.pop("", None)
    return found


def _tokens(text: str, mails: dict[str, dict[str, str]]) -> Iterator[tuple[int, int, str | None]]:
    """Start and end of each node, and the address that it resembles.

    Nodes are tokens with a digit or an @, names of addresses of the text, and `name at domain`. A name that could be a word
    (letters only) is one with its domain only.
    """
    if not mails:
        yield from ((*m.span(), None) for m in _TOKEN.finditer(text))
        return
    done = 0
    for m in _WORD.finditer(text):
        start, end = m.span()
        if start < done:
            continue
        core = _CORE.search(m[0])
        of = mails.get(core[0].lower()) if core else None
        mail = None
        if of:
            if (at := _AT.match(text, end)) and (domain := _DOMAIN.match(text, at.end())):
                if mail := of.get(domain[0].lower()):
                    end = domain.end()
            if not mail and not core[0].isalpha():
                mail = next(iter(of.values()))
        if mail or _MARK.search(m[0]):
            yield start, end, mail
            done = end


def _at(base: list[tuple[int, int, int]], at: int, start: int, end: int) -> list[tuple[int, int, int]]:
    """The addresses among base spans from at on that meet a token, as (start, kind, end)."""
    out = []
    while at < len(base) and base[at][0] < end:
        if base[at][1] == 0 and base[at][2] > start:
            out.append(base[at])
        at += 1
    return out


class _Graph:
    def __init__(self) -> None:
        # Flat arrays, so that a long text of many numbers takes some hundred bytes a node.
        self.unary, self.size = array("d"), 0
        self.ends_of, self.weights = array("q"), array("f")  # two nodes of each edge, and its weight
        self.docs, self.starts, self.stops = array("q"), array("q"), array("q")
        self.linked = bytearray()

    def link(self, a: int, b: int, weight: float) -> None:
        self.ends_of.extend((a, b))
        self.weights.append(weight)

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        last_end, at, equal, alike, ends, first = -2, 0, {}, {}, {}, self.size
        mails = _mail_parts(text, base)
        named: dict[str, int] = {}  # the node of each address, and nodes that wait for it
        waits: list[tuple[int, str]] = []
        for start, end, mail in _tokens(text, mails):
            while at < len(base) and base[at][2] <= start:
                at += 1
            kind = next((k for s, k, e in base[at : at + 3] if s < end and e > start), None)
            node = self.size
            self.size += 1
            token = text[start:end]
            self.unary.extend(_unary(token, text[max(0, start - 24) : start].rstrip('"\'`'), kind))
            self.docs.append(doc)
            self.starts.append(start)
            self.stops.append(end)
            self.linked.append(0)
            if start - last_end == 1:
                self.link(node - 1, node, CHAIN)
            last_end = end
            if mail and kind is None:
                waits.append((node, mail))
            elif kind == 0:
                for k, _, e in _at(base, at, start, end):
                    named.setdefault(text[k:e].lower(), node)
            core = _CORE.search(token)
            if core:
                word = core[0].lower()
                if len(word) >= 4:
                    if word in equal:
                        self.link(equal[word], node, SKIP)
                    equal[word] = node
                if len(word) >= LIKE:
                    # Tokens that differ in one place share a half.
                    h = len(word) // 2
                    near = {alike[k] for k in ((len(word), 0, word[:h]), (len(word), 1, word[h:])) if k in alike}
                    for n, w in near:
                        if w != word and sum(x != y for x, y in zip(w, word)) <= 2:
                            self.link(n, node, ALIKE)
                    alike[len(word), 0, word[:h]] = alike[len(word), 1, word[h:]] = (node, word)
                if not any(map(str.isalpha, word)):
                    self._link_digits(node, first, text, next(((s, e) for s, k, e in base[at : at + 3] if k in (2, 3) and s < end and e > start), None), ends)
        for node, mail in waits:
            if mail in named:
                self.link(named[mail], node, SKIP)

    def _link_digits(self, node: int, first: int, text: str, span: tuple[int, int] | None, ends: dict) -> None:
        """Link a number to the last one of which it is the end, or which is its end; its parts before it in a run, too.

        A base span counts as a whole, at its last token. A token has LINKS such links to base spans and as many to others at most.
        """
        start, end = self.starts[node], self.stops[node]
        if span and _digits(text[end : span[1]]):
            return
        digits = _digits(text[span[0] : span[1]] if span else text[start:end])
        run = node  # the first token of the number
        while run > first and self.starts[run] - self.stops[run - 1] == 1:
            s, e = self.starts[run - 1], self.stops[run - 1]
            if not 0 < len(before := _digits(text[s:e])) <= 6 or any(map(str.isalpha, text[s:e])) or span and e <= span[0] or len(digits) >= 19:
                break
            run -= 1
            if not span:
                digits = before + digits
        if len(digits) < END:
            return
        key = digits[-END:]
        if key in ends:
            other, known, based = ends[key]
            n, one = 0, 16 if based else 1
            while n < min(len(digits), len(known)) and digits[-1 - n] == known[-1 - n]:
                n += 1
            own = 0  # digits from a token of the run on
            for i in range(node, run - 1, -1):
                own += len(_digits(text[self.starts[i] : self.stops[i]]))
                if own > n and i < node:
                    break
                if (own <= n or n == len(known)) and self.linked[i] // one % 16 < LINKS:
                    self.linked[i] += one
                    self.link(other, i, SKIP)
                if own >= n:
                    break
        if key not in ends or span or len(digits) >= len(ends[key][1]):
            ends[key] = (node, digits, bool(span))

    def labels(self) -> np.ndarray:
        """Of each node, the label of the largest belief; outside unless its share is over one half."""
        u = np.array(self.unary).reshape(-1, OUT + 1)
        belief, m = u.copy(), len(self.weights)
        if m:
            a, b = np.array(self.ends_of).reshape(-1, 2).T
            w = np.array(self.weights)
            old, new = (np.zeros((2, m, OUT + 1), np.float32) for _ in range(2))  # messages from a to b, and from b to a
            for _ in range(ROUNDS):
                after = u.copy()
                for way, (src, dst) in enumerate(((a, b), (b, a))):
                    for k in range(0, m, STEP):
                        at = slice(k, k + STEP)
                        out = belief[src[at]] - old[1 - way, at]
                        # Agreement adds w, so a message is log(sum(exp) + (e^w - 1) exp(own)).
                        out -= out.max(1, keepdims=True)
                        e = np.exp(out)
                        out = np.log(e.sum(1, keepdims=True) + np.expm1(w[at])[:, None] * e)
                        new[way, at] = 0.5 * (old[way, at] + out - out.mean(1, keepdims=True))
                        np.add.at(after, dst[at], new[way, at])
                belief, old, new = after, new, old
        belief -= belief.max(1, keepdims=True)
        share = np.exp(belief)
        share /= share.sum(1, keepdims=True)
        best = share.argmax(1)
        return np.where(share.max(1) > 0.5, best, OUT)


class _Taken:
    """Whether a part of a text meets one of its base spans; parts are asked for in ascending order."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.spans, self.at, self.reach = spans, 0, -1  # reach: the largest end of the spans that begin before the part's end

    def meets(self, start: int, end: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][0] < end:
            self.reach = max(self.reach, self.spans[self.at][2])
            self.at += 1
        return self.reach > start


def find_spans(texts: list[str]) -> list[tuple[list, list]]:
    """Of each text its base spans and those that the field adds, as (start, kind, end)."""
    bases = [base_spans(t) for t in texts]
    added: list[list] = [[] for _ in texts]
    graph = _Graph()
    for i, t in enumerate(texts):
        if _MARK.search(t):
            graph.add(i, t, bases[i])
        if graph.size > NODES:
            _add_spans(graph, texts, bases, added)
            graph = _Graph()
    _add_spans(graph, texts, bases, added)
    return list(zip(bases, added))


def _add_spans(graph: _Graph, texts: list[str], bases: list[list], added: list[list]) -> None:
    """The spans of nodes that the field labels and no base span meets; pieces of one number are one span."""
    if not graph.size:
        return
    last, doc_at, taken = None, -1, _Taken([])
    for doc, start, end, kind in zip(graph.docs, graph.starts, graph.stops, graph.labels().tolist()):
        if doc != doc_at:
            doc_at, taken = doc, _Taken(bases[doc])
        if kind == OUT or taken.meets(start, end):
            continue
        core = _CORE.search(texts[doc], start, end)
        if core is None:
            continue
        start, end = core.span()
        own = added[doc]
        if last == (doc, kind) and kind in (2, 3) and 0 < start - own[-1][2] <= 2 and not texts[doc][own[-1][2] : start].strip(" ()-."):
            own[-1] = (own[-1][0], kind, end)
        else:
            own.append((start, kind, end))
        last = (doc, kind)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256, spans (base and added), n_added."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            found = find_spans([t or "" for t in batch.column(1).to_pylist()])
            count = lambda kind: [sum(k == kind for _, k, _ in b) for b, _ in found]
            return {"doc_id": batch.column(0), "n_email": count(0), "n_ip": count(1), "n_card": count(2), "n_phone": count(3), "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(sorted(b + a)) for b, a in found], "n_added": [len(a) for _, a in found]}

        return work

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of overlapping spans, as [KIND] of the first."""
    out, end = [], 0
    for s, k, e in sorted(spans):
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data masked in text, and n_chars (if there) of the new text; null texts stay null."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            found = find_spans([t or "" for t in texts])
            new = [t if t is None or not (b or a) else masked(t, b + a) for t, (b, a) in zip(texts, found)]
            columns = list(batch.columns)
            columns[place] = pa.array(new, batch.column(place).type)
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([n if t is None or t == old else len(t) for t, old, n in zip(new, texts, columns[i].to_pylist())], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read_table(spark, sf_dir, "documents"))
