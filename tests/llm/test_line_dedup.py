"""Line dedup against a plain version, through a sent index and through a routed one."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, least=5):
    key = lambda x: x.strip(BLANKS).translate(LOWER)
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                held.setdefault(k, []).append(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < least or max(held[key(x)]) in (-1, i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **how):
    got = line_dedup.drop_frequent_lines(df, **how).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("most", [line_dedup.MAX_INDEX, 0])
def test_equals_plain_version(spark, sf, most):
    a, b, short, wide = "A line that many documents have, in many forms", "é" * 40, "x" * 39, "ü" * 20
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(1000 + i, "\n".join([f"own {i} " * 9, ("\t" * i) + (a if i % 2 else a.upper()) + "\r", "", b, short, wide, a])) for i in range(7)]
    rows += [(2000 + i, b + "\n" + f"held by four: {'y' * 40}") for i in range(4)]
    rows += [(3000, a), (3000, a), (None, a), (None, None), (4000, None), (4001, ""), (4002, "\n\n"), (4003, "z" * 2_000_000), (4004, (a + "\n") * 20_000)]
    rows += [(None, "only rows without an id hold this line, five of them") for _ in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    clashing = df.withColumns({c: F.lit(7) for c in ("n_lines", "row", "shard", "_id", "h1", "top")})
    got = line_dedup.drop_frequent_lines(clashing, most=most)
    assert got.columns == ["doc_id", "text", "row", "shard", "_id", "h1", "top", "n_lines", "n_dropped"]
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()), key=str) == by_force(rows)


@pytest.mark.parametrize("most", [line_dedup.MAX_INDEX, 0])
def test_no_rows_and_no_frequent_lines(spark, most):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert found(empty, most=most) == []
    assert found(empty.unionByName(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")), most=most) == by_force([(1, "a\nb")])


def test_perfect_hash_is_minimal_and_finds_members_only():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, (50_000, 2)).astype(np.uint64)
    h[:100, 0] = h[0, 0]  # equal first halves
    shard = np.mod(h[:, 0].view(np.int64), 4)
    rows, truth = [], {}
    for s in range(4):
        own = np.flatnonzero(shard == s)
        words, order = line_dedup.perfect_hash(h[own, 0], h[own, 1])
        rows.append({"shard": s, "levels": [w.tobytes() for w in words], "prints": h[own, 1][order].tobytes(), "counts": own[order].astype(np.uint32).tobytes(), "holders": own[order].astype(np.int64).tobytes()})
        truth[s] = len(own)
    index = line_dedup.Index(rows, 4)
    slots = index.slots(h[:, 0].copy(), h[:, 1].copy())
    assert sorted(slots.tolist()) == list(range(50_000)) and index.holders[slots].tolist() == list(range(50_000))
    assert 64 * len(index.words) / 50_000 < 5
    other = rng.integers(0, 1 << 63, (50_000, 2)).astype(np.uint64)
    assert (index.slots(other[:, 0].copy(), other[:, 1].copy()) == -1).all()


def test_query_drops_lines(spark, sf):
    rows = line_dedup.op13_line_dedup(spark, sf).collect()
    assert sum(r.n_dropped for r in rows) > 0 and all(re.fullmatch("[0-9a-f]{64}", r.kept_sha256) for r in rows)
