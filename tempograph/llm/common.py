"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most, and of a table of sources or languages that is broadcast.
ROWS, MAX_BROADCAST_KEYS = 1000, 100_000
#: What counts as white space between words: the six ASCII ones.
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder in spark.checkpoint.dir, which all executors see.

    Where that is unset, a local master (tests) gets a temporary folder; a cluster is an error, as executors share no local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tempograph-")
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/tempograph-{uuid.uuid4().hex}")
    return _made[-1]


def forget(spark: SparkSession) -> None:
    """Delete the folders that operators of this process have written; results that aren't written elsewhere are lost."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends, and executors may be lost."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(keys: DataFrame) -> DataFrame:
    """A table of a row a key, written, and to be broadcast if it has few rows; else it is joined by shuffle."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys


def tidy(run: Callable) -> Callable:
    """run, after which a worker process gives freed memory back: it lives on beside the next stage's.

    Rows of texts are large, so the session's Arrow batches are held to ROWS rows.
    """
    conf = SparkSession.active().conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS)

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ctypes
        import gc

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return tidied


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict | None]], schema: str, step: int = 512) -> DataFrame:
    """Run make()(batch) -> columns over Arrow batches of at most step rows; make is called once a task."""
    names = [f.name for f in df.sparkSession.createDataFrame([], schema).schema.fields]
    types = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(types)
        work = make()
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            if (out := work(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=arrow.field(n).type) for n in names], names=names)

    return df.mapInArrow(tidy(run), schema)


def word_count(text):
    """Number of [^\\x20\\x09-\\x0D]+ words of a text column, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ordinals(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows, written, with their place (from 0 on) in the order of their group and its size; group and order are columns without nulls.

    Rows are dealt by ranges of group and order, so a group of any size is spread over tasks; each range's own counts give where
    it begins. That table has a row a range and group in it, so at most groups + partitions rows.
    """
    ranged = cut(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))
    held = ranged.groupBy("_range", group).agg(F.count("*").alias("_rows"))
    of = Window.partitionBy(group)
    begins = F.coalesce(F.sum("_rows").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("_range", group, begins.alias("_begins"), F.sum("_rows").over(of).alias("size"))
    inside = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order)).cast("long")
    return ranged.join(held, ["_range", group]).withColumn("place", inside - 1 + F.col("_begins")).drop("_range", "_begins")
