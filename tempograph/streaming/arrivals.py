"""Structured Streaming forms: first-seen rows, daily observations, quarters, and the stateful duplicate test of postings."""

from __future__ import annotations

import functools
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import indel, normalize_title
from ..schema import period_of
from ..sources.shared import shared_folder


def read_events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, file = path.rsplit("/", 1)
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder) if not _is_folder(spark, path) else spark.readStream.schema(schema).parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def first_seen(events: DataFrame, key: list[str], ts: str, delay: str = "10 days") -> DataFrame:
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def daily(events: DataFrame, by: list[str], ts: str, delay: str = "2 days") -> DataFrame:
    w = F.window(ts, "1 day")
    return events.withWatermark(ts, delay).groupBy(w, *by).agg(F.count("*").alias("n")).select(F.to_date("window.start").cast("string").alias("day"), *by, "n")


def quarterly(events: DataFrame, by: list[str], ts: str) -> DataFrame:
    """period, by, n: quarters have no fixed length, so they are a key and their rows are updated for as long as the stream runs."""
    return events.groupBy(period_of(F.to_date(ts)).alias("period"), *by).agg(F.count("*").alias("n"))


#: Groups of blocks. A call of Python takes a group's rows and its state: one for each block would cost more than its rows.
GROUPS = 2048


def duplicates(postings: DataFrame, by: list[str], days: int = 60, least: float = 92.0, delay: str = "1 day") -> DataFrame:
    """posting_id, duplicate_of of a stream (posting_id, ts, title and by): the first canonical row of the block within days whose title fits.

    The state of a block is its canonical rows of the last days; those older than that before the watermark are let go, and a block
    without rows for so long is forgotten. Blocks are dealt to GROUPS groups, whose blocks' states are kept together. Rows of a micro-batch are taken by time and id. Rows without a time, or with an empty title
    or part of by, have no duplicate and are none's, as in the batch form.
    """
    rows = postings.withWatermark("ts", delay).select("posting_id", "ts", *by, normalize_title("title").alias("key")).withColumn("block", F.to_json(F.struct(*by)))
    fit = F.col("ts").isNotNull() & (F.coalesce("key", F.lit("")) != "")
    for b in by:
        fit = fit & F.col(b).isNotNull() & (F.col(b).cast("string") != "")
    apart = rows.where(~fit).select("posting_id", F.lit(None).cast("long").alias("duplicate_of"))
    rows = rows.where(fit)

    def run(key, frames: Iterator, state) -> Iterator:
        import pandas as pd

        like = functools.lru_cache(10_000)(indel)
        if state.hasTimedOut:
            state.remove()
            return
        held: dict[str, list[tuple]] = {}
        for block, *row in zip(*state.get) if state.exists else ():
            held.setdefault(block, []).append(tuple(row))
        g = pd.concat(list(frames)).sort_values(["ts", "posting_id"])
        out = []
        for i, n, title, block in zip(g["posting_id"], (g["ts"] - pd.Timestamp(0)).dt.days.tolist(), g["key"], g["block"]):
            own = held.setdefault(block, [])
            hit = next((c for c, m, t in own if abs(n - m) <= days and (t == title or like(title, t) >= least)), None)
            if hit is None:
                own.append((int(i), n, title))
            out.append((i, hit))
        mark = state.getCurrentWatermarkMs() // 86_400_000
        left = [(block, *x) for block, own in held.items() for x in own if x[1] >= mark - days]
        state.update(tuple([x[k] for x in left] for k in range(4)))
        state.setTimeoutTimestamp(max([*(x[2] for x in left), mark, 0]) * 86_400_000 + (days + 1) * 86_400_000)
        yield pd.DataFrame({"posting_id": pd.array([i for i, _ in out], "Int64"), "duplicate_of": pd.array([h for _, h in out], "Int64")})

    grouped = rows.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(GROUPS)))
    found = grouped.groupBy("group").applyInPandasWithState(run, "posting_id long, duplicate_of long", "blocks array<string>, ids array<long>, numbers array<long>, titles array<string>", "append", "EventTimeTimeout")
    return found.unionByName(apart)


def drain(stream: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there; its rows are files in the shared folder, read again.

    key names the columns of a row that later batches update; without one, rows are appended only.
    """
    spark = stream.sparkSession
    folder = shared_folder(spark)

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(add).outputMode("update" if key else "append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, _batch int").parquet(f"{folder}/rows")
    if key:
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_batch")))).where("_place = 1")
    return rows.select(stream.columns)
