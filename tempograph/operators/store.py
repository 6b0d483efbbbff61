"""The graph's tables as they are stored: made by versioned DDL, written by partition, bucketed by role.

A store is a folder that all executors see, and a database of external tables in it, so that another session finds both. Observations
and edges are cut by (ontology_version, period): a write touches the partitions that come in, and no other file. Edges are bucketed by
role, so that slices join on it without a shuffle. What was read to be merged is written aside first, as its own files go.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import first_existing
from ..sources.shared import kept

BUCKETS = 16
PARTS = ["ontology_version", "period"]
#: What each version of the schema adds, as statements with the database and the folder left open.
MIGRATIONS: dict[int, list[str]] = {
    1: [
        "CREATE TABLE IF NOT EXISTS {db}.role (role_id STRING, name STRING, state STRING) USING parquet LOCATION '{root}/role'",
        "CREATE TABLE IF NOT EXISTS {db}.skill (skill_id STRING, name STRING, ontology_version STRING) USING parquet LOCATION '{root}/skill'",
        "CREATE TABLE IF NOT EXISTS {db}.requires (role_id STRING, skill_id STRING, weight DOUBLE, posting_count BIGINT, total_postings BIGINT, ontology_version STRING, period STRING) USING parquet PARTITIONED BY (ontology_version, period) CLUSTERED BY (role_id) SORTED BY (role_id, skill_id) INTO {buckets} BUCKETS LOCATION '{root}/requires'",
    ],
    2: [
        "CREATE TABLE IF NOT EXISTS {db}.observation (role_id STRING, skill_id STRING, weight DOUBLE, posting_count BIGINT, total_postings BIGINT, ontology_version STRING, period STRING) USING parquet PARTITIONED BY (ontology_version, period) LOCATION '{root}/observation'",
        "CREATE TABLE IF NOT EXISTS {db}.evidence (evidence_id STRING, source_id STRING, posting_id STRING, skill_id STRING, span_start INT, span_end INT, quote STRING, extractor STRING, confidence DOUBLE) USING parquet PARTITIONED BY (source_id) LOCATION '{root}/evidence'",
        "CREATE TABLE IF NOT EXISTS {db}.source (source_id STRING, name STRING, kind STRING) USING parquet LOCATION '{root}/source'",
    ],
}
LEDGER = "schema_version"


def migrate(spark: SparkSession, root: str, db: str, upto: int | None = None) -> list[int]:
    """Bring a store up to a version (the last by default); the versions that were applied now, none if it was there already.

    The ledger in the store says what has been applied; a session that hasn't seen the tables yet gets them from their files.
    """
    root = root.rstrip("/")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {db}.{LEDGER} (version INT, applied_at TIMESTAMP) USING parquet LOCATION '{root}/{LEDGER}'")
    done = {r.version for r in spark.table(f"{db}.{LEDGER}").select("version").collect()}  # a row a version
    new = []
    for version in sorted(v for v in MIGRATIONS if upto is None or v <= upto):
        for statement in MIGRATIONS[version]:
            spark.sql(statement.format(db=db, root=root, buckets=BUCKETS))
            name = re.search(r"\{db\}\.(\w+)", statement)[1]
            if "PARTITIONED BY" in statement and first_existing(spark, [f"{root}/{name}"]):
                spark.sql(f"ALTER TABLE {db}.{name} RECOVER PARTITIONS")
        if version not in done:
            spark.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("applied_at")).write.insertInto(f"{db}.{LEDGER}")
            new.append(version)
    return new


def _checked(rows: DataFrame, key: list[str], role: bool) -> DataFrame:
    """The last word on each key; an error for periods that are none and, for edges, for rows without a role."""
    bad = ~F.coalesce(F.col("period").rlike("^[0-9]{4}Q[1-4]$"), F.lit(False))
    bad = bad | F.col("role_id").isNull() | (F.col("role_id") == "") if role else bad
    if not rows.where(bad).isEmpty():
        raise ValueError("a period that isn't like 2024Q1" + (", or a row without a role" if role else ""))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("posting_count"), F.desc("total_postings"), F.desc("weight")))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


@contextmanager
def _dynamic(spark: SparkSession):
    """Writes into a table replace the partitions that come in, and only these."""
    conf = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def put_partitions(spark: SparkSession, name: str, rows: DataFrame, role: bool) -> list[tuple]:
    """Upsert rows by role, skill, version and period; the partitions that were rewritten. A null role is the global one.

    Rows of the touched partitions that don't come in stay; other partitions are neither read nor written.
    """
    key = ["_role", "skill_id", *PARTS]
    columns = spark.table(name).columns
    named = rows.withColumn("_role", F.coalesce("role_id", F.lit("")))
    rows = kept(_checked(named, key, role))
    touched = sorted(tuple(r) for r in rows.select(*PARTS).distinct().collect())  # a row a version and quarter
    if not touched:
        return []
    of = F.lit(False)
    for version, period in touched:
        of = of | (F.col("ontology_version").eqNullSafe(F.lit(version)) & (F.col("period") == period))
    old = spark.table(name).where(of).withColumn("_role", F.coalesce("role_id", F.lit("")))
    merged = kept(old.join(rows.select(*key), key, "left_anti").select(columns).unionByName(rows.select(columns)))
    # Rows of a partition go to few files: one a bucket, or as many as their number asks for.
    dealt = merged.repartition(BUCKETS, "role_id") if role else merged.repartition(*PARTS)
    with _dynamic(spark):
        dealt.write.mode("overwrite").insertInto(name)
    return touched


def put_observations(spark: SparkSession, db: str, rows: DataFrame) -> list[tuple]:
    return put_partitions(spark, f"{db}.observation", rows, role=False)


def _rewrite(spark: SparkSession, name: str, rows: DataFrame) -> None:
    kept(rows).write.mode("overwrite").insertInto(name)


def put_graph(spark: SparkSession, db: str, observations: DataFrame, roles: DataFrame | None = None) -> list[tuple]:
    """Edges of observations, with nodes for their ends: a role's name and state are those of roles (role_id, name, state), if given.

    Ends that aren't there yet are made, named by their ids; a skill that is there keeps its name and version.
    """
    observations = kept(observations)
    touched = put_partitions(spark, f"{db}.requires", observations, role=True)
    role, skill = spark.table(f"{db}.role"), spark.table(f"{db}.skill")
    if roles is not None:
        new = roles.dropDuplicates(["role_id"]).select("role_id", "name", "state")
        _rewrite(spark, f"{db}.role", role.join(new.select("role_id"), "role_id", "left_anti").select(role.columns).unionByName(new))
    ends = observations.select("role_id").distinct().join(spark.table(f"{db}.role").select("role_id"), "role_id", "left_anti")
    kept(ends.select("role_id", F.col("role_id").alias("name"), F.lit("published").alias("state"))).write.insertInto(f"{db}.role")
    ends = observations.groupBy("skill_id").agg(F.min("ontology_version").alias("ontology_version")).join(skill.select("skill_id"), "skill_id", "left_anti")
    kept(ends.select("skill_id", F.col("skill_id").alias("name"), "ontology_version")).write.insertInto(f"{db}.skill")
    return touched


def put_new(spark: SparkSession, name: str, rows: DataFrame, key: list[str]) -> int:
    """Insert the rows whose key isn't there, the smallest of each; how many those were."""
    columns = spark.table(name).columns
    first = rows.groupBy(*key).agg(F.min(F.struct(*[c for c in columns if c not in key])).alias("_row")).select(*key, "_row.*").select(columns)
    new = kept(first.join(spark.table(name).select(*key), key, "left_anti").select(columns))
    new.write.insertInto(name)
    return new.count()


def slice_edges(spark: SparkSession, db: str, version: str, period: str) -> DataFrame:
    """role_id, skill_id, weight of one partition, by bucket.

    The session is set to join on role and skill by the buckets of roles (spark.sql.requireAllClusterKeysForCoPartition is off).
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return spark.table(f"{db}.requires").where((F.col("ontology_version") == version) & (F.col("period") == period)).select("role_id", "skill_id", "weight")
