"""Mergeable quantile summaries: weighted collapse with alternating offsets, tracked errors, and exact ranks to verify the answers.

A summary is a list of points (x, weight), the weights adding up to the rows. When buffers of points are collapsed, the smallest and
the largest x and the two heaviest others stay as they are; of the rest, sorted with each x repeated by its weight, every s-th is
kept with weight s, where s follows from the number of points that may stay. The first one is taken in the middle: for odd s at
(s + 1) / 2, for even s at s / 2 and s / 2 + 1 in turn. That shifts the estimated rank of any x by no more than the larger part of s
before or behind a kept point, known exactly, and this adds up over collapses and merges: the answer to a target rank is off by at
most the sum (`error`). Which turn is taken follows from the group and the number of rows, so reruns agree.

Tasks fill buffers as rows come: at CHUNK rows, groups of over 2 * BUFFER points are collapsed to BUFFER, smaller ones pass as they
are. Groups of FEW points or more in a chunk are dealt to at most SALTS tasks and collapsed there, again and again as points come, so
that a group of any size reaches its last task as at most SALTS * BUFFER points a batch. There each batch is summarised within the
budget, and the group's whole from these summaries only.

Verification counts exactly. Rows meet their group's answers, a range join: equal group and part of the range, then x below, or up to,
each answer, summed up. The target-th smallest x is the first one whose running sum reaches the target. Groups of more than 1 / HOT
of all rows are cut at their own summary's points (their number is bounded, so these are broadcast), and each part begins at the
exact count of those before it.

Rows lacking group or money, or of money that isn't finite, are dropped; a null id is of batch 0. Of repeated ids, the first row that
arrived counts, of those the smallest. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table, tidy

#: Points of a summary, steps of the answers, rows from which a summary is asked, batches.
BUDGET, STEPS, ASKED, BATCHES = 400, 10, 20, 8
#: Rows of a chunk; points of a working buffer; points of a group in a chunk that are dealt; to how many tasks.
CHUNK, BUFFER, FEW, SALTS = 1 << 18, 1024, 64, 256
#: Share of all rows from which a group is cut into parts, and the least rows of such a group.
HOT, LARGE = 512, 1 << 14
WHOLE = -1
_POINTS = "stream int, grp string, batch int, salt int, x long, w long, error long"


def collapse(x: np.ndarray, w: np.ndarray, most: int, turn: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most `most` of ascending different points with weights, and by how much ranks may have moved."""
    if len(x) <= most:
        return x, w, 0
    heavy = 1 + np.lexsort((x[1:-1], -w[1:-1]))[:2]
    stays = np.zeros(len(x), bool)
    stays[[0, -1, *heavy]] = True
    rest, weight = x[~stays], w[~stays]
    sums = np.cumsum(weight)
    total, room = int(sums[-1]), most - int(stays.sum())
    s = -(-total // room)
    at = (s + 1) // 2 if s % 2 else s // 2 + turn
    places = np.arange(at, total + 1, s)
    picked = np.searchsorted(sums, places)
    each = np.full(len(places), s, np.int64)
    each[-1] = total - s * (len(places) - 1)
    first = np.flatnonzero(np.append(True, picked[1:] != picked[:-1]))
    out_x, out_w = np.concatenate([x[stays], rest[picked[first]]]), np.concatenate([w[stays], np.add.reduceat(each, first)])
    order = np.argsort(out_x, kind="stable")
    return out_x[order], out_w[order], max(at - 1, s - at, total - int(places[-1]))


class Groups:
    """Sorted points of several groups: keys is a table of a row a group, begin where each group's points begin."""

    def __init__(self, table: pa.Table, names: list[str]) -> None:
        """table: points in which groups are whole and their rows adjacent; equal x of a group become one point."""
        n = table.num_rows
        change = np.zeros(n, bool)
        for name in names:
            c = table.column(name).combine_chunks()
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        change[0] = True
        group = np.cumsum(change) - 1
        self.keys = table.select(names).take(pa.array(np.flatnonzero(change)))
        x, w = table.column("x").to_numpy(), table.column("w").to_numpy()
        self.error = np.bincount(group, table.column("error").to_numpy(), minlength=self.keys.num_rows).astype(np.int64)
        self._fill(group, x, w)

    def _fill(self, group: np.ndarray, x: np.ndarray, w: np.ndarray) -> None:
        order = np.lexsort((x, group))
        group, x, w = group[order], x[order], w[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (group[1:] != group[:-1])))
        self.group, self.x, self.w = group[first], x[first], np.add.reduceat(w, first)
        self.begin = np.append(np.flatnonzero(np.append(True, self.group[1:] != self.group[:-1])), len(self.x))

    def sizes(self) -> np.ndarray:
        return np.diff(self.begin)

    def rows(self) -> np.ndarray:
        return np.add.reduceat(self.w, self.begin[:-1])

    def shrink(self, most: int, above: int) -> None:
        """Collapse the groups of more than `above` points to `most`."""
        large = np.flatnonzero(self.sizes() > above)
        if not len(large):
            return
        rows, keep, more = self.rows(), np.ones(len(self.x), bool), []
        for g in large.tolist():
            lo, hi = self.begin[g], self.begin[g + 1]
            keep[lo:hi] = False
            x, w, off = collapse(self.x[lo:hi], self.w[lo:hi], most, int(rows[g] + self.error[g]) % 2)
            self.error[g] += off
            more.append((np.full(len(x), g), x, w))
        parts = [(self.group[keep], self.x[keep], self.w[keep]), *more]
        self._fill(*(np.concatenate(c) for c in zip(*parts)))

    def over(self, names: list[str]) -> Groups:
        """The summaries of the groups that these names tell apart, merged; groups of one are adjacent."""
        points = self.keys.select(names).take(pa.array(self.group)).append_column("x", pa.array(self.x)).append_column("w", pa.array(self.w))
        error = np.zeros(len(self.x), np.int64)
        error[self.begin[:-1]] = self.error
        return Groups(points.append_column("error", pa.array(error)), names)

    def table(self) -> pa.Table:
        """The points as rows; a group's error stands at its first one."""
        error = np.zeros(len(self.x), np.int64)
        error[self.begin[:-1]] = self.error
        t = self.keys.take(pa.array(self.group))
        return t.append_column("x", pa.array(self.x)).append_column("w", pa.array(self.w)).append_column("error", pa.array(error))

    def answers(self) -> np.ndarray:
        """A row a group: the first points at which the weights reach i / STEPS of the rows, rounded up, for i in 1..STEPS - 1."""
        sums = np.cumsum(self.w)
        before = sums[self.begin[:-1]] - self.w[self.begin[:-1]]
        target = -(-np.arange(1, STEPS)[None, :] * self.rows()[:, None] // STEPS)
        return self.x[np.searchsorted(sums, before[:, None] + target)]


def _whole_groups(batches: Iterator[pa.RecordBatch], cut_at: list[str], names: list[str], most: int) -> Iterator[Groups]:
    """Groups by names of points that come sorted by cut_at, in blocks that hold all groups of one cut_at.

    Where one of these has more than CHUNK points, its groups are collapsed to `most` as the points come.
    """
    need, held, size = [*names, "x", "w", "error"], [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]).select(need))
        size += batch.num_rows
        if size < CHUNK:
            continue
        table = pa.concat_tables(held)
        same = np.ones(table.num_rows, bool)
        for name in cut_at:
            same &= pc.equal(table.column(name), table.column(name)[-1]).to_numpy()
        at = int(same.argmax())  # rows are sorted, so those like the last one are the last ones
        if at:
            yield Groups(table.slice(0, at), names)
        rest = table.slice(at)
        if rest.num_rows >= CHUNK:
            g = Groups(rest, names)
            g.shrink(most, most)
            rest = g.table()
        held, size = [rest], rest.num_rows
    if size:
        yield Groups(pa.concat_tables(held), names)


def _batches(table: pa.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    yield from table.select(names).combine_chunks().to_batches(max_chunksize=1 << 16)


def _partials(rows: DataFrame) -> DataFrame:
    """Points of the buffers that tasks fill; salt: the task that groups of many points go to, -1 for those of few.

    rows is a written table, so that a task that runs again meets its rows in the same order and makes the same chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0

        def full() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held).combine_chunks()
            code = table.column("grp").combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.lexsort((table.column("batch").to_numpy(), code, table.column("stream").to_numpy()))
            table = table.take(pa.array(order)).append_column("error", pa.array(np.zeros(len(order), np.int64)))
            g = Groups(table, ["stream", "grp", "batch"])
            g.shrink(BUFFER, 2 * BUFFER)
            salt = np.where(g.sizes() >= FEW, (task * 31 + chunk) % SALTS, -1).astype(np.int32)
            yield from _batches(g.table().append_column("salt", pa.array(salt[g.group])), ["stream", "grp", "batch", "salt", "x", "w", "error"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= CHUNK:
                yield from full()
                chunk, held, size = chunk + 1, [], 0
        if size:
            yield from full()

    return rows.select("stream", "grp", "batch", "x", "w").mapInArrow(tidy(run), _POINTS)


def summaries(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """stream, grp, batch (-1: the whole), n, points, error, answers, at (the points) of rows (stream, grp, batch, x, w), a written table."""
    keys = ["stream", "grp", "batch"]

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, [*keys, "salt"], [*keys, "salt"], BUFFER):
            g.shrink(BUFFER, BUFFER)
            yield from _batches(g.table(), [*keys, "salt", "x", "w", "error"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _whole_groups(batches, keys[:2], keys, BUFFER):
            g.shrink(budget, budget)
            whole = g.over(keys[:2])
            whole.shrink(budget, budget)
            for one in (g, whole):
                n = one.rows()
                asked = pa.array(np.flatnonzero(n >= ASKED))
                t = one.keys if "batch" in one.keys.column_names else one.keys.append_column("batch", pa.array(np.full(len(n), WHOLE, np.int32)))
                answers = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * (STEPS - 1)), pa.array(one.answers().ravel()))
                at = pa.ListArray.from_arrays(pa.array(one.begin.astype(np.int32)), pa.array(one.x))
                for name, c in (("n", pa.array(n)), ("points", pa.array(one.sizes())), ("error", pa.array(one.error)), ("answers", answers), ("at", at)):
                    t = t.append_column(name, c)
                yield from _batches(t.take(asked), [*keys, "n", "points", "error", "answers", "at"])

    parts = cut(_partials(rows))
    dealt = parts.where("salt >= 0").repartition(*keys, "salt").sortWithinPartitions(*keys, "salt").mapInArrow(tidy(salted), _POINTS)
    met = parts.where("salt < 0").unionByName(dealt).repartition(*keys[:2]).sortWithinPartitions(*keys)
    return met.mapInArrow(tidy(last), "stream int, grp string, batch int, n long, points long, error long, answers array<long>, at array<long>")


def _part(x: Column, step: int = 20) -> Column:
    """How many of the points `at` are x or less; 0 where there are none. First every step-th is looked at, then those between."""
    tops = F.size(F.filter("tops", lambda p: p <= x))
    return F.coalesce(tops * step + F.size(F.filter(F.slice("at", tops * step + 1, F.lit(step)), lambda p: p <= x)), F.lit(0))


def exact_ranks(rows: DataFrame, found: DataFrame) -> DataFrame:
    """stream, grp, batch with below, upto (rows below and up to each answer) and exact (the x at each target), arrays; found is written."""
    keys = ["stream", "grp", "batch"]
    most = (found.where(F.col("batch") == WHOLE).agg(F.sum("n")).first()[0] or 0) // HOT
    tops = F.transform(F.sequence(F.lit(1), F.ceil(F.size("at") / 20).cast("int") - 1), lambda k: F.element_at("at", k * 20))
    tops = F.when(F.size("at") > 20, tops).otherwise(F.array().cast("array<long>")).alias("tops")
    large = F.col("n") > max(LARGE, most)
    hot = F.broadcast(cut(found.where(large).select(*keys, "at", tops)))  # at most 2 * HOT rows of BUDGET points
    both = rows.withColumn("batch", F.explode(F.array("batch", F.lit(WHOLE))))
    counted = both.join(hot, keys).withColumn("part", _part(F.col("x"))).groupBy(*keys, "part").agg(F.sum("w").alias("w"))
    before = F.coalesce(F.sum("w").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counted.withColumn("before", before).select(*keys, "part", "before").join(found.where(large).select(*keys, "n", "answers"), keys)
    plain = found.where(~large).select(*keys, F.lit(0).alias("part"), F.lit(0).cast("long").alias("before"), "n", "answers")
    placed = both.join(hot, keys, "left").select(*keys, "x", "w", _part(F.col("x")).alias("part")).join(plain.unionByName(parts), [*keys, "part"])
    inside = Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("sum", F.sum("w").over(inside) + F.col("before"))
    sums = []
    for i in range(1, STEPS):
        a = F.element_at("answers", i)
        sums += [F.sum(F.when(F.col("x") < a, F.col("w")).otherwise(0)).alias(f"below{i}"), F.sum(F.when(F.col("x") <= a, F.col("w")).otherwise(0)).alias(f"upto{i}")]
        sums.append(F.min(F.when(F.col("sum") >= F.expr(f"({i} * n + {STEPS - 1}) div {STEPS}"), F.col("x"))).alias(f"exact{i}"))
    counts = placed.groupBy(*keys).agg(*sums)
    return counts.select(*keys, *[F.array(*[F.col(f"{c}{i}") for i in range(1, STEPS)]).alias(c) for c in ("below", "upto", "exact")])


def verified(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """stream, grp, batch, i, n, target, exact_x, points, answer, n_below, n_upto, rank_error, error_bound of rows (stream, grp, batch, x, w)."""
    keys = ["stream", "grp", "batch"]
    rows = cut(rows)
    found = cut(summaries(rows, budget))
    each = F.posexplode(F.arrays_zip("answers", "below", "upto", "exact")).alias("i", "r")
    t = found.drop("at").join(exact_ranks(rows, found), keys).select(*keys, "n", "points", "error", each)
    t = t.select(*keys, (F.col("i") + 1).alias("i"), "n", "points", "error", "r.*").withColumn("target", F.expr(f"(i * n + {STEPS - 1}) div {STEPS}"))
    off = F.greatest(F.lit(0), F.col("below") + 1 - F.col("target"), F.col("target") - F.col("upto")).cast("long")
    return t.select(*keys, "i", "n", "target", F.col("exact").alias("exact_x"), "points", F.col("answers").alias("answer"), F.col("below").alias("n_below"), F.col("upto").alias("n_upto"), off.alias("rank_error"), F.col("error").alias("error_bound"))


def batch_of(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % BATCHES, F.lit(0)).cast("int")


def _x(money: Column, batch: Column) -> Column:
    return (F.floor(100 * money + 0.5) + 1000 * batch).cast("long")


def shop_rows(clicks: DataFrame, sale_lines: DataFrame, items: DataFrame) -> DataFrame:
    """stream (0 value, 1 price), grp, batch, x, w: rows of equal item and batch are one, of weight w."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    order = Window.partitionBy("click_id").orderBy(F.asc_nulls_last("arrived_at"), "client_id", "value")
    clicks = clicks.select("click_id", "arrived_at", "client_id", F.col("value").cast("double").alias("value"))
    known = clicks.where("click_id is not null").withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")
    once = known.unionByName(clicks.where("click_id is null")).where(F.col("client_id").isNotNull() & finite("value"))
    value = once.select(F.lit(0).alias("stream"), F.col("client_id").cast("string").alias("grp"), batch_of(F.col("click_id")).alias("batch"), "value").select("stream", "grp", "batch", _x(F.col("value"), F.col("batch")).alias("x"), F.lit(1).cast("long").alias("w"))
    lines = sale_lines.where("item_id is not null").groupBy("item_id", batch_of(F.col("vendor_id")).alias("batch")).agg(F.count("*").alias("w"))
    priced = items.select("item_id", "brand", F.col("price").cast("double").alias("price")).where(F.col("brand").isNotNull() & finite("price"))
    price = lines.join(priced, "item_id").select(F.lit(1).alias("stream"), F.col("brand").cast("string").alias("grp"), "batch", _x(F.col("price"), F.col("batch")).alias("x"), "w")
    return value.unionByName(price)


def op12_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shop_rows(*(read_table(spark, sf_dir, t) for t in ("clicks", "sale_lines", "items")))
    t = verified(rows).withColumn("stream", F.when(F.col("stream") == 0, "value").otherwise("price"))
    return t.withColumn("within", 1000 * F.col("rank_error") <= 50 * F.col("n"))
