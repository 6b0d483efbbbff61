"""The provided tables in the roles of the data model: postings, mentions, profiles, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import period_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posting_id, role_id (segment), company, city, source_id (priority), day, period; one row an order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    day = F.to_date("o_orderdate")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("posting_id"), F.col("c_mktsegment").alias("role_id"), F.col("o_custkey").alias("company"), F.col("c_nationkey").alias("city"), F.col("o_orderpriority").alias("source_id"), day.alias("day"), period_of(day).alias("period"))


def mentions(spark: SparkSession, sf_dir: str, sparse: bool = False) -> DataFrame:
    """posting_id, skill_id, distinct; skills are brands, or brand and type."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.concat_ws("/", "p_brand", "p_type") if sparse else F.col("p_brand")).alias("skill_id"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("posting_id"), "skill_id").distinct()


#: The same as DuckDB common table expressions: p, md (dense mentions), ms (sparse mentions).
SQL_BASE = """
p AS (SELECT o_orderkey AS posting_id, c_mktsegment AS role_id, o_custkey AS company, c_nationkey AS city, o_orderpriority AS source_id,
  CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period FROM orders JOIN customer ON o_custkey = c_custkey),
md AS (SELECT DISTINCT l_orderkey AS posting_id, p_brand AS skill_id FROM lineitem JOIN part ON l_partkey = p_partkey),
ms AS (SELECT DISTINCT l_orderkey AS posting_id, p_brand || '/' || p_type AS skill_id FROM lineitem JOIN part ON l_partkey = p_partkey)
"""


def sql_obs(name: str, key: str | None, mentions: str) -> str:
    """A common table expression with the observations by key (a column of p), or over all."""
    k, kk = (f"{key}, ", f"{key}, ") if key else ("", "")
    join = f"USING ({key}, period)" if key else "USING (period)"
    return f"""{name} AS (SELECT {k}skill_id, period, CAST(n AS BIGINT) AS posting_count, CAST(total AS BIGINT) AS total_postings, CAST(n AS DOUBLE) / total AS weight FROM
  (SELECT {kk}skill_id, period, count(DISTINCT p.posting_id) AS n FROM p JOIN {mentions} USING (posting_id) GROUP BY ALL) JOIN (SELECT {kk}period, count(DISTINCT posting_id) AS total FROM p GROUP BY ALL) {join})"""
