"""The Merkle manifest against a plain one, on groups of many sizes and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tempograph.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def climb(nodes):
    """The root of [(hash, keys below)], and siblings by key."""
    proof = {k: [] for _, ks in nodes for k in ks}
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for run in runs:
            for i, (_, ks) in enumerate(run):
                for k in ks:
                    proof[k].append(([x for x, _ in run[:i]], [x for x, _ in run[i + 1 :]]))
        nodes = [(h("".join(x for x, _ in run)), [k for _, ks in run for k in ks]) for run in runs]
    return nodes[0][0] if nodes else None, proof


def by_force(rows):
    lower = str.maketrans(manifest.UPPER, manifest.LOWER)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault((r.lang is not None, (r.lang or "").encode()), []).append(i)
    leaves, subroots, proofs = {i: leaf(r, r.text) for i, r in enumerate(rows)}, [], {}
    for g in sorted(groups):
        order = sorted(groups[g], key=lambda i: (rows[i].doc_id is not None, rows[i].doc_id or 0, leaves[i]))
        top, proof = climb([(leaves[i], [i]) for i in order])
        subroots.append((top, order))
        proofs |= proof
    root, over = climb(subroots)
    out = []
    for top, order in subroots:
        for i in order:
            r = rows[i]
            path = proofs[i] + over[i]
            now = leaves[i] if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 or r.text is None else leaf(r, r.text.translate(lower))
            for before, after in path:
                now = h("".join(before) + now + "".join(after))
            out.append((r.doc_id, leaves[i], top, root, h("".join("".join(b + a) for b, a in path)), now, now == root))
    return sorted(out, key=str)


def found(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in manifest.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_equals_plain_tree(spark, tmp_path):
    rows = [(i, f"Text {i} of SIZE", lang, "s", i) for lang, n in (("a", 1), ("b", 8), ("c", 9), (None, 65), ("é", 600), ("", 2)) for i in range(n)]
    rows += [(None, "x", "a", None, None), (None, None, None, None, None), (5, None, "b", "s", 1), (5, "Same", "b", "s", 1), (5, "Same", "b", "s", 1), (6, "", "c", "", 0), (7, "WORD " * 100_000, "z", "s", 3)]
    rows += [(i, "T", f"lang {i}", "s", 1) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(spark, df.withColumns({c: F.lit("x") for c in ("place", "size", "hash", "group", "path", "_by")}), tmp_path) == by_force(df.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 8])
def test_small_tables(spark, tmp_path, n):
    df = spark.createDataFrame([(i, "A", "en", "s", 1) for i in range(n)], SCHEMA)
    assert found(spark, df, tmp_path) == by_force(df.collect())


def test_groups_of_any_width(spark):
    df = spark.createDataFrame([(i, "t", "en", "s", 1) for i in range(30)], SCHEMA)
    got = manifest.proofs(df, width=3).withColumn("folded", manifest.fold(F.col("leaf"), F.col("path")))
    assert got.where("folded = root").count() == 30 and got.select(F.size("path")).distinct().collect() == [(4,)]
