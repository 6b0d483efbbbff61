"""Quantile summaries against exact ranks, on tables, streams of buffers, ties and odd rows."""

import bisect
import collections
import math
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tempograph.llm import quantiles


def rows_of(folder):
    q = lambda s: duckdb.sql(s).fetchall()
    clicks = q(f"SELECT DISTINCT click_id, client_id, value FROM '{folder}/clicks.parquet'")
    lines = q(f"SELECT vendor_id, brand, price FROM '{folder}/sale_lines.parquet' JOIN '{folder}/items.parquet' USING (item_id)")
    return [("value", i, g, v) for i, g, v in clicks] + [("price", i, g, v) for i, g, v in lines]


def groups_by_force(rows):
    held = collections.defaultdict(list)
    for stream, i, grp, money in rows:
        if grp is not None and money is not None and math.isfinite(money):
            batch = zlib.crc32(str(i).encode()) % 8 if i is not None else 0
            x = math.floor(100 * money + 0.5) + 1000 * batch
            held[stream, str(grp), batch].append(x)
            held[stream, str(grp), -1].append(x)
    return {k: sorted(v) for k, v in held.items() if len(v) >= 20}


def hold(got, want, budget=400):
    assert {(r.stream, r.grp, r.batch, r.i) for r in got} == {(*k, i) for k in want for i in range(1, 10)} and len(got) == 9 * len(want)
    last = {}
    for r in sorted(got, key=lambda r: r.i):
        xs = want[r.stream, r.grp, r.batch]
        t = -(-r.i * len(xs) // 10)
        below, upto = bisect.bisect_left(xs, r.answer), bisect.bisect_right(xs, r.answer)
        assert (r.n, r.target, r.exact_x, r.n_below, r.n_upto, r.rank_error) == (len(xs), t, xs[t - 1], below, upto, max(0, below + 1 - t, t - upto))
        assert r.rank_error <= r.error_bound and min(4, len(set(xs))) <= r.points <= min(len(xs), budget)
        assert last.get((r.stream, r.grp, r.batch), r.answer) <= r.answer
        last[r.stream, r.grp, r.batch] = r.answer


def test_query_equals_exact_ranks(spark, sf):
    got = quantiles.op12_quantiles(spark, sf).collect()
    hold(got, groups_by_force(rows_of(sf)))
    assert all(r.within for r in got)


@pytest.mark.parametrize("large", [1 << 14, 50])
def test_groups_of_many_rows_and_ties(spark, monkeypatch, large):
    monkeypatch.setattr(quantiles, "LARGE", large)  # also as if nearly all groups were hot
    rng = np.random.default_rng(5)
    rows = [(s, g, int(b), int(x), int(w)) for s, g, n, top in ((0, "hot", 30_000, 10**9), (0, "ties", 5000, 3), (1, "heavy", 2000, 50), (1, "few", 25, 9)) for b, x, w in zip(rng.integers(0, 8, n), rng.integers(-top, top, n), 1 + rng.integers(0, 3, n) ** (12 if g == "heavy" else 1))]
    held = collections.defaultdict(list)
    for s, g, b, x, w in rows:
        held[s, g, b] += [x] * w
        held[s, g, -1] += [x] * w
    want = {k: sorted(v) for k, v in held.items() if len(v) >= 20}
    hold(quantiles.verified(spark.createDataFrame(rows, "stream int, grp string, batch int, x long, w long").repartition(7), 40).collect(), want, 40)


def test_odd_and_empty_tables(spark, tmp_path):
    clicks = "click_id long, arrived_at timestamp, client_id long, value double, kind string"
    lines, items = "item_id long, vendor_id long, grp string", "item_id long, brand string, price double, x long"
    c = [(i, None, 1, float(i % 5), "k") for i in range(30)] * 2 + [(100, None, None, 1.0, "k"), (101, None, 1, None, "k"), (102, None, 1, float("nan"), "k"), (103, None, 1, float("inf"), "k"), (None, None, 1, 1.0, "k"), (None, None, 1, 1.0, "k")]
    sl = [(1, i, "g") for i in range(40)] + [(None, 1, "g"), (2, 1, "g"), (3, 1, "g"), (9, 1, "g"), (1, None, "g")]
    it = [(1, "", 2.5, 0), (2, None, 1.0, 0), (3, "b", None, 0)]
    frames = [spark.createDataFrame(r, s) for r, s in ((c, clicks), (sl, lines), (it, items))]
    want = groups_by_force([("value", i, g, v) for i, g, v in {(x[0], x[2], x[3]) for x in c[:-2]}] + [("value", x[0], x[2], x[3]) for x in c[-2:]] + [("price", v, "", 2.5) for i, v, _ in sl if i == 1])
    got = quantiles.verified(quantiles.shop_rows(*frames)).replace(0, 0).collect()
    hold([r for r in got], {(("value", "price").index(k[0]), *k[1:]): v for k, v in want.items()})
    assert quantiles.verified(quantiles.shop_rows(*[f.limit(0) for f in frames])).collect() == []


def test_collapse_keeps_weight_ends_and_its_error():
    rng = np.random.default_rng(1)
    for n, most, top in ((500, 5, 1), (1000, 40, 1), (1001, 40, 9), (300, 299, 2), (700, 64, 10**6)):
        x = np.sort(rng.choice(10**6, n, replace=False))
        w = rng.integers(1, top + 1, n)
        for turn in (0, 1):
            a, v, off = quantiles.collapse(x, w, most, turn)
            assert len(a) <= most and v.sum() == w.sum() and (a[0], a[-1]) == (x[0], x[-1]) and (v > 0).all() and (np.diff(a) > 0).all()
            true = np.cumsum(w)
            near = np.append(0, np.cumsum(v))[np.searchsorted(a, x, "right")]
            assert np.abs(true - near).max() <= off


def test_long_streams_of_one_group_are_collapsed_as_they_come(monkeypatch):
    monkeypatch.setattr(quantiles, "CHUNK", 1000)
    rng = np.random.default_rng(2)
    parts = [("a", 30), ("b", 20_000), ("c", 1500), ("d", 10)]
    rows = [(g, int(x)) for g, n in parts for x in rng.integers(0, 10**6, n)]
    batches = [pa.record_batch({"grp": [g for g, _ in b], "x": [x for _, x in b], "w": [1] * len(b), "error": [0] * len(b), "more": [0] * len(b)}) for b in (rows[i : i + 300] for i in range(0, len(rows), 300))]
    held = {}
    for g in quantiles._whole_groups(iter(batches), ["grp"], ["grp"], 200):
        assert len(g.x) <= 2200
        for k, n, e, a in zip(g.keys.column("grp").to_pylist(), g.rows().tolist(), g.error.tolist(), g.answers().tolist()):
            assert k not in held
            held[k] = n, e, a
    for name, n in parts:
        xs = sorted(x for g, x in rows if g == name)
        assert held[name][0] == n
        for i, a in enumerate(held[name][2], 1):
            t = -(-i * n // 10)
            assert max(0, bisect.bisect_left(xs, a) + 1 - t, t - bisect.bisect_right(xs, a)) <= held[name][1] <= n // 20
