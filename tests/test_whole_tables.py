"""Queries without SQL against plain versions over whole tables."""

import math
import re

import numpy as np
import pytest

from tempograph import registry
from tempograph.operators import evolve, graph
from tempograph.plans import evolution, profiles

from .test_graph_selection import by_search


@pytest.fixture(scope="module")
def texts(spark, sf):
    return [(r.doc_id, r.source, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def mentions_by_force(text, vocabulary):
    """Leftmost whole words, of several the longest, none of which overlap."""
    forms = sorted(vocabulary, key=len, reverse=True)
    found, at = [], 0
    while at < len(text):
        hit = next((f for f in forms if text.startswith(f, at) and (not f.isascii() or not re.match(r"[0-9A-Za-z_]", text[at - 1 : at] if at else "") and not re.match(r"[0-9A-Za-z_]", text[at + len(f) : at + len(f) + 1]))), None)
        if hit:
            found.append((at, at + len(hit), vocabulary[hit], hit))
        at += len(hit) if hit else 1
    return found


def test_mentions_and_their_evidence(spark, sf, texts):
    want = {(i, *m) for i, _, t in texts for m in mentions_by_force(t, profiles.VOCABULARY)}
    assert {tuple(r) for r in registry.QUERIES["scan_mentions"](spark, sf).collect()} == want and len(want) > 50
    first = {}
    for i, s, e, skill, surface in sorted(want):
        first.setdefault((i, skill), (s, e, surface))
    got = {(r.doc_id, r.skill_id): (r.span_start, r.span_end, r.quote) for r in registry.QUERIES["first_mention_evidence"](spark, sf).collect()}
    assert got == first


def grams(block):
    t = block.casefold()
    return {t[i : i + 3] for i in range(len(t) - 2)} or {t}


def blocks_by_force(text):
    """(start, end, block) of runs up to and with a full stop or line end."""
    out, at = [], 0
    for part in re.findall("[^。\n]*[。\n]|[^。\n]+$", text):
        out.append((at, at + len(part), part.strip(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85   　")))
        at += len(part)
    return [b for b in out if len(b[2]) >= 8]


def test_blocks_of_peers_and_their_spans(spark, sf, texts):
    by_source = {}
    for i, source, t in texts:
        for _, _, b in blocks_by_force(t):
            by_source.setdefault(source, {}).setdefault(b, set()).add(t)
    want = set()
    for source, held in by_source.items():
        sets = [(b, grams(b), of) for b, of in held.items()]
        want |= {(source, b) for b, _, of in sets if len(of) > 1}
        for k, (b, g, of) in enumerate(sets):
            for c, h, other in sets[:k]:
                if 0.8 * max(len(g), len(h)) <= min(len(g), len(h)) and len(of | other) > 1 and len(g & h) >= 0.8 * len(g | h):
                    want |= {(source, b), (source, c)}
    assert {tuple(r) for r in registry.QUERIES["minhash_near_dups"](spark, sf).collect()} == want and len(want) > 5
    spans = {r.doc_id: r.spans for r in registry.QUERIES["boilerplate_spans"](spark, sf).collect()}
    for i, source, t in texts:
        merged = []
        for s, e, b in blocks_by_force(t):
            if (source, b) in want:
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(e, merged[-1][1])
                else:
                    merged.append([s, e])
        assert spans[i] == ",".join(f"{s}-{e}" for s, e in merged), i


def test_text_of_pages(spark, sf):
    got = {r.page_id: r.text for r in registry.QUERIES["html_text"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    import html

    for r in rows:
        if r.html is None:
            assert got[r.page_id] is None
            continue
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", r.html)
        bare = re.sub(r"(?s)<!--.*?-->|<[!?/a-zA-Z][^>]*>", "\0", bare)
        want = "\n".join(x for x in (html.unescape(p).strip() for p in bare.split("\0")) if x)
        assert re.sub(r"\s+", "", got[r.page_id]) == re.sub(r"\s+", "", want), r.page_id


def test_prerequisites_by_a_search_for_each(spark, sf):
    rows = [r for q in ("prereq_hierarchy", "prereq_asymmetry", "prereq_seniority") for r in registry.QUERIES[q](spark, sf).collect()]
    rows.sort(key=lambda r: (graph.RULE_ORDER[r.rule], -r.confidence, r.src, r.dst))
    want = [(r.src, r.dst, r.rule, r.confidence) for r, ok in zip(rows, by_search([r.src for r in rows], [r.dst for r in rows])) if ok]
    assert sorted(map(tuple, registry.QUERIES["prereq_acyclic"](spark, sf).collect())) == sorted(want) and len(want) > 50


def tail_by_force(f, a, b, steps=200_000):
    """P(F > f) by the sum of its density's substitution, where F = b x / (a (1 - x)) and x is of the beta distribution."""
    x0 = a * f / (a * f + b)
    t = (np.arange(steps) + 0.5) / steps
    # x = 1 - (1 - x0) t^2 takes the ends' poles away
    x = 1 - (1 - x0) * t**2
    y = x ** (a / 2 - 1) * (1 - x) ** (b / 2 - 1) * (1 - x0) * 2 * t
    return float(y.sum() / steps / math.exp(math.lgamma(a / 2) + math.lgamma(b / 2) - math.lgamma((a + b) / 2)))


def test_tests_of_leading_series(spark, sf):
    o = evolution.obs(spark, sf, ["source_id"]).collect()
    series = {name: {(r.skill_id, r.period): r.weight for r in o if r.source_id == source} for name, source in (("x", evolution.LEAD), ("y", evolution.LAG))}
    got = registry.QUERIES["lead_lag_granger"](spark, sf).collect()
    assert len(got) > 5
    for r in got:
        periods = sorted(p for s, p in series["x"] if s == r.skill_id and (s, p) in series["y"])
        x, y = (np.array([series[k][r.skill_id, p] for p in periods]) for k in "xy")
        n, k, p = len(periods), r.lag_order, 1.0
        if n >= 8 and n - 3 * k - 1 > 0:
            rows = range(k, n)
            own = np.array([[1.0, *(y[t - i] for i in range(1, k + 1))] for t in rows])
            both = np.array([[*own[t - k], *(x[t - i] for i in range(1, k + 1))] for t in rows])
            rest = lambda m: float(((y[k:] - m @ np.linalg.pinv(m) @ y[k:]) ** 2).sum())  # noqa: B023, E731
            a, b = rest(own), rest(both)
            free = n - 3 * k - 1
            p = tail_by_force((a - b) / k / (b / free), k, free) if b > 1e-18 else r.p_value
        assert abs(p - r.p_value) < 2e-3, (r, p)


def test_clusters_are_no_worse_than_by_rounds(spark, sf):
    e = graph.pair_counts(evolution.edges(spark, sf)).selectExpr("a", "b", "cast(both as double) AS weight")
    one = registry.QUERIES["louvain_clusters"](spark, sf)
    q = evolve.modularity(e, one)
    members = {r.skill_id: r.cluster_id for r in one.collect()}
    weights = {(r.a, r.b): r.weight for r in e.collect()}
    total = sum(weights.values())
    degree = {}
    for (a, b), w in weights.items():
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w
    assert set(members) == set(degree)
    plain = sum(w for (a, b), w in weights.items() if members[a] == members[b]) / total - sum(sum(d for s, d in degree.items() if members[s] == c) ** 2 for c in set(members.values())) / (2 * total) ** 2
    assert abs(q - plain) < 1e-9 and q >= -1e-12
    assert q >= evolve.modularity(e, evolve.communities(e)) - 0.02


def test_paths_keep_their_order(spark, sf):
    before = {}
    for r in profiles.chain(spark, sf).collect():
        before.setdefault(r.dst, set()).add(r.src)
    steps = {}
    for r in registry.QUERIES["learning_path"](spark, sf).collect():
        steps.setdefault(r.profile_id, []).append((r.step_order, r.skill_id))
    assert len(steps) > 10
    for path in steps.values():
        order = [s for _, s in sorted(path)]
        assert len(set(order)) == len(order)
        for i, s in enumerate(order):
            for p in before.get(s, ()):
                assert p not in order[i + 1 :] or s in before.get(p, ()), (p, s)


def test_lexicon_places(spark, sf, texts):
    want = set()
    for i, _, t in texts:
        taken = []
        for w in sorted(profiles.PLAIN_WORDS, key=lambda w: (-len(w), w)):
            for m in re.finditer(re.escape(w), t, re.I):
                s, e = m.span()
                if not re.match("[A-Za-z0-9_+]", t[s - 1 : s] if s else "") and not re.match("[A-Za-z0-9_+]", t[e : e + 1]) and all(e <= a or s >= b for a, b in taken):
                    taken.append((s, e))
                    want.add((i, w, s, e, t[s:e]))
                    break
    assert {(r.doc_id, r.name, r.start, r.end, r.surface) for r in registry.QUERIES["lexicon_mentions"](spark, sf).collect()} == want and want


def test_no_query_without_sql_is_left_out():
    tested = {"scan_mentions", "first_mention_evidence", "minhash_near_dups", "boilerplate_spans", "html_text", "prereq_acyclic", "lead_lag_granger", "louvain_clusters", "learning_path", "lexicon_mentions"}
    elsewhere = {"recall_candidates", "discover_emerging"}  # test_documents; discover_planted has SQL
    assert set(registry.QUERIES) - set(registry.SQL) == tested | elsewhere
