"""Acyclic selection against a search for each edge, on small graphs, dense ones and by connected parts."""

import random
import time

import pytest

from tempograph.operators import graph


def by_search(src, dst):
    after, out = {}, []
    for a, b in zip(src, dst):
        seen, stack = {b}, [b]
        while stack and a not in seen:
            for x in after.get(stack.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        ok = a not in seen and b not in after.get(a, ())
        if ok:
            after.setdefault(a, set()).add(b)
        out.append(ok)
    return out


@pytest.mark.parametrize("n,m", [(1, 5), (5, 60), (50, 400), (300, 2000), (2000, 3000), (30, 2000)])
def test_order_that_is_kept_up_equals_a_search(n, m):
    for seed in range(6):
        r = random.Random(seed)
        src, dst = ([r.randrange(n) for _ in range(m)] for _ in range(2))
        assert graph.acyclic(src, dst, n) == by_search(src, dst)
    assert graph.acyclic([], [], 0) == []


def test_a_hundred_thousand_edges_are_chosen_in_time():
    r = random.Random(1)
    src, dst = ([r.randrange(20_000) for _ in range(100_000)] for _ in range(2))
    began = time.time()
    assert 70_000 < sum(graph.acyclic(src, dst, 20_000)) < 80_000 and time.time() - began < 60


def candidates(spark, seed, n=60, m=240):
    r = random.Random(seed)
    rows = [(f"s{r.randrange(n)}", f"s{r.randrange(n)}", r.choice(["hierarchy", "asymmetry", "seniority", "manual"]), r.randrange(5) / 5) for _ in range(m)]
    rows += [(f"chain{i}", f"chain{i + 1}", "hierarchy", 0.5) for i in range(30)] + [("x", "y", "asymmetry", 0.2), ("y", "x", "hierarchy", 0.1), ("y", "z", "manual", 0.1), ("z", "x", "seniority", 0.9), ("o", "o", "manual", 1.0)]
    return rows, spark.createDataFrame(rows, "src string, dst string, rule string, confidence double")


@pytest.mark.parametrize("at_once", [1_000_000, 0])
def test_parts_are_chosen_as_the_whole(spark, at_once):
    for seed, n in ((1, 60), (2, 400)):
        rows, df = candidates(spark, seed, n)
        rows = sorted(rows, key=lambda e: (graph.RULE_ORDER[e[2]], -e[3], e[0], e[1]))
        want = [e for e, ok in zip(rows, by_search([e[0] for e in rows], [e[1] for e in rows])) if ok]
        assert sorted(map(tuple, graph.select_acyclic(df, at_once).collect())) == sorted(want)
    assert graph.select_acyclic(df.limit(0), at_once).count() == 0


def test_connected_parts(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(0, 70)] + [("p", "q"), ("r", "q"), ("b", "c")]
    got = {r.node: r.part for r in graph.connected(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert {got[f"n{i:03}"] for i in range(71)} == {"n000"} and got["r"] == got["p"] == "p" and got["c"] == "b"
