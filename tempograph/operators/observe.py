"""Observations: how large a share of a period's postings mentions a skill; latest periods, moves and pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def observations(postings: DataFrame, mentions: DataFrame, by: list[str]) -> DataFrame:
    """by, skill_id, period, posting_count, total_postings, weight. mentions are distinct, so counts need no second distinct."""
    keys = [*by, "period"]
    total = postings.groupBy(*keys).agg(F.countDistinct("posting_id").alias("total_postings"))
    n = postings.select("posting_id", *keys).distinct().join(mentions, "posting_id").groupBy(*keys, "skill_id").agg(F.count("*").alias("posting_count"))
    return n.join(total, keys).select(*by, "skill_id", "period", "posting_count", "total_postings", (F.col("posting_count") / F.col("total_postings")).alias("weight"))


def latest_period(obs: DataFrame, by: list[str]) -> DataFrame:
    return obs.groupBy(*by).agg(F.max("period").alias("latest_period"))


def market_moves(obs: DataFrame, period: str, previous: str, band: float = 0.02, top: int = 8) -> DataFrame:
    """skill_id, delta, direction, place: the largest moves beyond the band; skills that are gone are not looked at."""
    now = obs.where(F.col("period") == period).select("skill_id", "weight")
    before = obs.where(F.col("period") == previous).select("skill_id", F.col("weight").alias("was"))
    raw = F.col("weight") - F.coalesce("was", F.lit(0.0))
    moved = now.join(before, "skill_id", "left").select("skill_id", F.round(raw, 4).alias("delta"), F.when(raw > band, "rise").when(raw < -band, "fall").alias("direction"))
    w = Window.partitionBy("direction").orderBy(F.desc(F.abs("delta")), "skill_id")
    return moved.where("direction is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def top_skills(obs: DataFrame, n: int = 12) -> DataFrame:
    return obs.groupBy("skill_id").agg(F.sum("weight").alias("total_weight")).orderBy(F.desc(F.round("total_weight", 9)), "skill_id").limit(n)


def pivot_series(obs: DataFrame, periods: list[str]) -> DataFrame:
    """skill_id and a column of percent for each period, 0 where nothing was seen."""
    return obs.where(F.col("period").isin(periods)).groupBy("skill_id").pivot("period", periods).agg(F.round(100 * F.first("weight"), 1)).na.fill(0.0)
