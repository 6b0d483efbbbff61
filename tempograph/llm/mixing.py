"""Mixing sources to target weights, in DataFrame expressions only.

Tokens are summed by source (pre-aggregated in each task, so a source of any size is a few rows a task). Targets share the sum
of all sizes by weight, stop at a multiple of their source's size, and pass the excess on by weight; with sources in the order
of cap / weight the end of that process is a prefix of capped ones, found with running sums over the table of sources. Each
document is then emitted floor(rate) times plus one Bernoulli copy, whose probability is the fraction of the rate.

Draws by themselves would take a source of few long documents far from its target. So they are drawn together, systematically: the
documents of a source stand by size (equal sizes by a keyed hash), and one offset, drawn by a hash of seed and source, decides for
all: the one at place k has its copy where floor(offset + (k + 1) f) exceeds floor(offset + k f). The offset is uniform, so each
document's copy has probability f over seeds, whatever its size; and as sizes ascend, a source's words miss the target by at most
one largest document. Places come from ranges of (source, size), so no source lies in one task.

A null text has size 0. The null source is a source, the last one. Rows of one doc_id and source are one unit and draw alike, those
without doc_id by their text. A source of size 0 has target 0 and its documents are not taken. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, ordinals, read_table, sized, word_count

WEIGHTS, CAP, SEED = (5, 2, 1), 3, 17


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size -> also target. One row a source: the windows run over sources, not documents."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    place = (F.row_number().over(by_name) - 1) % len(weights)
    t = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1))
    t = t.withColumn("capped_at", cap * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("capped_at") / F.col("weight"), F.asc_nulls_last("source"))
    before, onward, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    t = t.withColumn("all", F.sum("source_size").over(every).cast("double")).withColumn("before", F.coalesce(F.sum("capped_at").over(before), F.lit(0.0)))
    t = t.withColumn("is_capped", F.col("capped_at") / F.col("weight") < (F.col("all") - F.col("before")) / F.sum("weight").over(onward))
    free = F.sum(F.when(~F.col("is_capped"), F.col("weight"))).over(every)
    left = F.col("all") - F.coalesce(F.sum(F.when(F.col("is_capped"), F.col("capped_at"))).over(every), F.lit(0.0))
    return t.withColumn("target", F.when(F.col("is_capped"), F.col("capped_at")).otherwise(left * F.col("weight") / free)).select("source", "source_size", "target")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))


def _tie(seed: int) -> Column:
    """The unit that a row is of, as a keyed hash."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))


def _offset(seed: int) -> Column:
    """Uniform in [0, 1) from seed and source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("source_key")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def plan(rows: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """source_key, tie, source_size, target, copies of each unit of rows (source, source_key, tie, size), a written table; written."""
    t = targets(rows.groupBy("source", "source_key").agg(F.sum("size").alias("source_size")), weights, cap)
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    t = sized(t.select(_source_key().alias("source_key"), "source_size", "target", rate.alias("rate")))
    units = ordinals(rows.groupBy("source_key", "tie").agg(F.sum("size").alias("words")), "source_key", ["words", "tie"])
    at, f = F.col("place"), F.col("rate") - F.floor("rate")
    more = F.floor(_offset(seed) + (at + 1) * f) - F.floor(_offset(seed) + at * f)
    return cut(units.join(t, "source_key").select("source_key", "tie", "source_size", "target", (F.floor("rate") + more).cast("long").alias("copies")))


def _rows(docs: DataFrame, seed: int, *columns: str) -> DataFrame:
    return docs.select(*columns, F.col("source").cast("string").alias("source"), _source_key().alias("source_key"), _tie(seed).alias("tie"), word_count(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The documents of the mix, repeats as rows of their own, with the columns of docs."""
    copies = plan(cut(_rows(docs, seed)), weights, cap, seed).where("copies > 0").select("source_key", "tie", "copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    taken = docs.select(row, _source_key().alias("source_key"), _tie(seed).alias("tie")).join(copies, ["source_key", "tie"])
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def mixed_words(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words the mix takes of each document."""
    rows = cut(_rows(docs, seed, "doc_id"))
    return rows.join(plan(rows, seed=seed), ["source_key", "tie"]).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(read_table(spark, sf_dir, "documents"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS tie FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(f"{float(w)}" for w in WEIGHTS)}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS weight, {float(CAP)} * source_size AS capped_at FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, coalesce(sum(capped_at) OVER (ORDER BY capped_at / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY capped_at / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM w),
c AS (SELECT *, capped_at / weight < (total - before) / onward AS is_capped FROM o),
t AS (SELECT source, source_size, CASE WHEN is_capped THEN capped_at ELSE
  (total - coalesce(sum(capped_at) FILTER (is_capped) OVER (), 0)) * weight / (sum(weight) FILTER (NOT is_capped) OVER ()) END AS target FROM c),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE target / source_size END AS rate,
  CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce('1' || source, '0')), 1, 13) AS UBIGINT) AS DOUBLE) / {float(16**13)!r} AS turn FROM t),
u AS (SELECT source, tie, row_number() OVER (PARTITION BY source ORDER BY sum(size), tie) - 1 AS place FROM d GROUP BY source, tie)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + floor(turn + (place + 1) * (rate - floor(rate))) - floor(turn + place * (rate - floor(rate)))) AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.tie = u.tie
"""
