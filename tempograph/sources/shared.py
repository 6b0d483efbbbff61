"""Tables that are computed once and read several times: written to the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder in spark.checkpoint.dir; only a local master gets a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tempograph-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tempograph-{uuid.uuid4().hex}"


_kept: list[str] = []


def forget(spark: SparkSession) -> int:
    """Delete the tables that kept() has written in this process, and say how many; results that read them and aren't written elsewhere are lost."""
    n = len(_kept)
    while _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def kept(df: DataFrame) -> DataFrame:
    """df, written and read again: its lineage ends there."""
    path = shared_folder(df.sparkSession)
    _kept.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int, what: str) -> DataFrame:
    """df, if it has no more rows; else an error, before one task would get them all."""
    if df.count() > rows:
        raise ValueError(f"more than {rows} {what}: this step is sequential and holds them in one task")
    return df
