"""Files of raw rows and of vocabularies, by suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a .parquet, .jsonl or .json (one array) file or folder of such a name."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("jsonl", "ndjson"):
        return spark.read.json(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    raise ValueError(f"neither Parquet nor JSON: {path}")


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that is there, on any file system Spark reads."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return p
    return None


def slice_path(spark: SparkSession, folder: str, board: str, explicit: str | None = None) -> str | None:
    return explicit or first_existing(spark, [f"{folder}/{board}{end}" for end in (".jobs.parquet", ".parquet", ".jsonl")])


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """token, name of tab-separated lines; lines that begin with # are comments, a missing name is the token."""
    parts = F.split(F.trim("value"), "\t")
    lines = spark.read.text(path).where("trim(value) <> '' and not trim(value) like '#%'")
    token = F.trim(F.get(parts, F.lit(0)))
    return lines.select(token.alias("token"), F.coalesce(F.nullif(F.trim(F.get(parts, F.lit(1))), F.lit("")), token).alias("name"))


def since(rows: DataFrame, column: str, day: str | None) -> DataFrame:
    """Rows from a day on; those without a readable day stay."""
    at = F.substring(F.col(column).cast("string"), 1, 10).try_cast("date")
    return rows if day is None else rows.where(at.isNull() | (at >= F.lit(day).cast("date")))


def read_vocabulary(spark: SparkSession, folder: str, version: str) -> DataFrame:
    """id, name, surfaces of the skills under folder/version, folder/data or folder, aliases.jsonl beside them merged; empty if none.

    Surfaces are the name, its aliases, then those of the alias table, each once.
    """
    dirs = [f"{folder}/{version}", f"{folder}/data", folder]
    path = first_existing(spark, [f"{d}/{n}" for d in dirs for n in ("skills.json", "skills.jsonl")])
    if path is None:
        return spark.createDataFrame([], "id string, name string, surfaces array<string>")
    raw = read_rows(spark, path)
    for inner in ("skills", "items"):
        if inner in raw.columns and "id" not in raw.columns:
            raw = raw.select(F.explode(inner).alias("x")).select("x.*")
    aliases = F.col("aliases") if "aliases" in raw.columns else F.array().cast("array<string>")
    if "aliases" in raw.columns and raw.schema["aliases"].dataType.typeName() == "string":
        # A column of single aliases, or of arrays that Spark has kept as JSON text.
        aliases = F.coalesce(F.when(aliases.startswith("["), F.from_json(aliases, "array<string>")), F.array(aliases))
    s = raw.where("id is not null and name is not null and id <> '' and name <> ''").select(F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name"), F.coalesce(aliases, F.array().cast("array<string>")).alias("a"))
    table = first_existing(spark, [f"{path.rsplit('/', 1)[0]}/aliases.jsonl"])
    if table:
        extra = spark.read.json(table).where("skill_id is not null and surface <> ''").groupBy(F.col("skill_id").cast("string").alias("id")).agg(F.sort_array(F.collect_set(F.col("surface").cast("string"))).alias("more"))
        s = s.join(extra, "id", "left")
    else:
        s = s.withColumn("more", F.lit(None).cast("array<string>"))
    every = F.concat(F.array("name"), "a", F.coalesce("more", F.array().cast("array<string>")))
    return s.select("id", "name", F.array_distinct(F.filter(every, lambda x: x != "")).alias("surfaces"))
