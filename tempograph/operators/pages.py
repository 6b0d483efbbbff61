"""Compositions for pages: details of roles and skills, overviews of the graph and the market, and a person's home."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import check_period
from . import evolve, graph, observe


#: Ids and names of the two levels of skills.
FOUNDATION, METHOD = "level.foundation", "level.method"
LEVELS = {FOUNDATION: "基础层", METHOD: "方法层"}


def signal_band(strength: Column) -> Column:
    s = F.coalesce(strength, F.lit(0.0))
    return F.when(s >= 0.65, "strong").when(s >= 0.4, "medium").otherwise("weak")


def role_by_id(roles: DataFrame, role: str) -> DataFrame:
    return roles.where(F.col("role_id") == role)


def roles_by_name(roles: DataFrame) -> DataFrame:
    return roles.orderBy("name", "role_id")


def current_period(obs: DataFrame) -> str | None:
    """The latest period of all observations: one value."""
    return obs.agg(F.max("period").alias("p")).first()["p"]


def optional(df: DataFrame, **values: str | None) -> DataFrame:
    """The rows that agree with each value that is given; what is None isn't asked for, and is no part of the plan."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == value)
    return df


def skill_detail(skills: DataFrame, clusters: DataFrame) -> DataFrame:
    """skills (skill_id, name, parent_id, cluster_id) with parent_name and cluster_name, null where there is none."""
    parents = skills.select(F.col("skill_id").alias("parent_id"), F.col("name").alias("parent_name"))
    named = clusters.select("cluster_id", F.col("name").alias("cluster_name"))
    return skills.join(parents, "parent_id", "left").join(named, "cluster_id", "left").select("skill_id", "name", "parent_id", "parent_name", "cluster_id", "cluster_name")


def covered_requirements(obs: DataFrame, competencies: DataFrame, covers: DataFrame, period: str) -> DataFrame:
    """role_id, skill_id, weight, competency_id: a slice's requirements with the competencies of the same role that cover them.

    competencies is (competency_id, role_id), covers (competency_id, skill_id); a skill that no competency of the role covers has none.
    """
    own = competencies.select("competency_id", "role_id").join(covers.select("competency_id", "skill_id"), "competency_id")
    return graph.slice_of(obs, period).select("role_id", "skill_id", "weight").join(own, ["role_id", "skill_id"], "left")


def overview_nodes(obs: DataFrame, roles: DataFrame, skills: DataFrame, clusters: DataFrame, period: str, view: str = "stack") -> DataFrame:
    """id, kind, label, parent, level, emerging, candidate of a slice's skills and roles, and of clusters (stack) or levels (level)."""
    o = graph.slice_of(obs, check_period(period))
    known = o.select("skill_id").distinct().join(skills, "skill_id", "left")
    level = F.when(F.col("parent_id").isNotNull(), METHOD).otherwise(FOUNDATION)
    none = F.lit(None).cast("string")
    parent = F.col("cluster_id") if view == "stack" else level
    no = F.lit(False)
    s = known.select(F.col("skill_id").alias("id"), F.lit("skill").alias("kind"), F.coalesce("name", "skill_id").alias("label"), parent.alias("parent"), level.alias("level"), no.alias("emerging"), no.alias("candidate"))
    r = o.select("role_id").distinct().join(roles, "role_id", "left").select(F.col("role_id").alias("id"), F.lit("role").alias("kind"), F.coalesce("name", "role_id").alias("label"), none.alias("parent"), none.alias("level"),
                                                                             F.coalesce(F.col("is_emerging") & (F.col("state") == "published"), no).alias("emerging"), F.coalesce(F.col("state") == "unverified", no).alias("candidate"))
    if view == "stack":
        c = known.where("cluster_id is not null").select("cluster_id").distinct().join(clusters.select("cluster_id", F.col("name").alias("label")), "cluster_id", "left")
        top = c.select(F.col("cluster_id").alias("id"), F.lit("cluster").alias("kind"), F.coalesce("label", "cluster_id").alias("label"), none.alias("parent"), none.alias("level"), no.alias("emerging"), no.alias("candidate"))
    else:
        levels = F.explode(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])).alias("id", "label")
        top = obs.sparkSession.range(1).select(levels).select("id", F.lit("level").alias("kind"), "label", none.alias("parent"), F.col("id").alias("level"), no.alias("emerging"), no.alias("candidate"))
    return top.unionByName(s).unionByName(r)


def overview_edges(obs: DataFrame, skills: DataFrame, period: str, view: str = "stack") -> DataFrame:
    """id, source, target, kind: member (of a cluster or level), parent (both there, stack only) and requires."""
    o = graph.slice_of(obs, check_period(period))
    known = o.select("skill_id").distinct().join(skills, "skill_id", "left")
    parent = F.col("cluster_id") if view == "stack" else F.when(F.col("parent_id").isNotNull(), METHOD).otherwise(FOUNDATION)
    e = known.select(F.concat(F.lit("member:"), "skill_id").alias("id"), parent.alias("source"), F.col("skill_id").alias("target"), F.lit("member").alias("kind")).where("source is not null")
    if view == "stack":
        there = o.select(F.col("skill_id").alias("parent_id")).union(known.where("cluster_id is not null").select("cluster_id")).distinct()
        e = e.unionByName(known.where("parent_id is not null").join(there, "parent_id", "left_semi").select(F.concat(F.lit("parent:"), "skill_id").alias("id"), F.col("parent_id").alias("source"), F.col("skill_id").alias("target"), F.lit("parent").alias("kind")))
    return e.unionByName(o.select(F.concat_ws(":", F.lit("requires"), "role_id", "skill_id").alias("id"), F.col("role_id").alias("source"), F.col("skill_id").alias("target"), F.lit("requires").alias("kind")))


def panorama_of(obs: DataFrame, roles: DataFrame, period: str, family: str | None = None, tier: str | None = None, least: float = 0.0, limit: int = 200, published_only: bool = False) -> DataFrame:
    """role_id, skill_id, weight: the heaviest requirements of a slice, of a family, a tier, from a weight on, of published roles."""
    low, high = graph.TIERS[tier] if tier else (0.0, float("inf"))
    r = optional(roles, family_id=family)
    r = r.where("state = 'published'") if published_only else r
    rows = graph.slice_of(obs, period).where(graph.band(F.col("weight"), max(low, least), high)).join(r.select("role_id"), "role_id", "left_semi")
    return rows.orderBy(F.desc("weight"), "role_id", "skill_id").limit(min(max(limit, 1), 2000)).select("role_id", "skill_id", "weight")


def role_skills(obs: DataFrame, role: str, period: str) -> DataFrame:
    """The role's observations of the period; of all periods if it has none there."""
    own = obs.where(F.col("role_id") == role)
    here = own.agg(F.max((F.col("period") == period).cast("int")).alias("_here"))
    return own.join(F.broadcast(here), F.lit(True)).where((F.col("_here") == 0) | (F.col("period") == period)).drop("_here").orderBy("period", "skill_id")  # one row


def role_detail(obs: DataFrame, covers: DataFrame, role: str, period: str, previous: str) -> tuple[DataFrame, DataFrame]:
    """The skills of a role, and its changes since the slice before."""
    own = obs.where(F.col("role_id") == role)
    return role_skills(obs, role, period), graph.competency_diff(own, covers, previous, period)


def skill_page(obs: DataFrame, skill: str, period: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A skill's observations, its bursts over all roles together, and the roles that ask for it in the period."""
    own = obs.where(F.col("skill_id") == skill)
    series = own.groupBy("skill_id", "period").agg(F.sum("posting_count").alias("posting_count"), F.sum("total_postings").alias("total_postings"))
    return own.orderBy("period", "role_id"), evolve.bursts(series, ["skill_id"]), own.where(F.col("period") == period).select("role_id").distinct()


def market(obs: DataFrame, roles: DataFrame, covers: DataFrame, period: str, previous: str, bursts: int = 40, top: int = 12) -> dict[str, DataFrame]:
    """Emerging roles, candidates with their band and pieces of evidence, changes, first bursts, top skills and observations of a period."""
    here = graph.slice_of(obs, period)
    series = obs.groupBy("skill_id", "period").agg(F.sum("posting_count").alias("posting_count"), F.sum("total_postings").alias("total_postings"))
    return {
        "emerging": roles.where("is_emerging"),
        "candidates": roles.where("state = 'unverified'").withColumn("signal_band", signal_band(F.col("signal_strength"))),
        "changes": graph.competency_diff(obs, covers, previous, period),
        "bursts": evolve.bursts(series, ["skill_id"]).orderBy("skill_id", "start_period").limit(bursts),
        "top": observe.top_skills(here, top),
        "observations": here,
    }


def candidate_cards(roles: DataFrame, evidence: DataFrame) -> DataFrame:
    """Unverified roles with signal_band and evidence_count of evidence (role_id)."""
    n = evidence.groupBy("role_id").agg(F.count("*").alias("evidence_count"))
    return roles.where("state = 'unverified'").join(n, "role_id", "left").withColumns({"signal_band": signal_band(F.col("signal_strength")), "evidence_count": F.coalesce("evidence_count", F.lit(0))})


def me_home(obs: DataFrame, role: str, period: str, previous: str) -> tuple[DataFrame, DataFrame]:
    """What the role requires, and the moves of its skills since the slice before."""
    own = obs.where(F.col("role_id") == role)
    return role_skills(obs, role, period).select("skill_id", "weight"), observe.market_moves(own, period, previous)


#: Words for levels, and the bands of the sketch of the market that the page's mock has.
LEVEL_WORDS = {0: "未掌握", 1: "了解", 2: "掌握", 3: "精通"}
RISE, FALL = 0.015, -0.01


def mock_moves(obs: DataFrame, period: str, previous: str) -> DataFrame:
    """skill_id, delta, direction with bands that differ up and down; a skill that wasn't there has not changed."""
    was = obs.where(F.col("period") == previous).select("skill_id", F.col("weight").alias("was"))
    d = F.col("weight") - F.coalesce("was", "weight")
    return obs.where(F.col("period") == period).join(was, "skill_id", "left").select("skill_id", F.round(d, 6).alias("delta"), F.when(d > RISE, "rise").when(d < FALL, "fall").otherwise("flat").alias("direction"))


def put_changes(changes: DataFrame, incoming: DataFrame) -> DataFrame:
    """The bitemporal log of changes (change_id, ..., occurred_on, recorded_at, superseded): rows are added or replaced by id, none is superseded."""
    new = incoming.withColumn("superseded", F.lit(False)).select(changes.columns)
    return changes.join(new.select("change_id"), "change_id", "left_anti").select(changes.columns).unionByName(new)


def as_of(changes: DataFrame, recorded: str) -> DataFrame:
    """What was known at a time: of each change of a role, competency and day the row recorded last before it."""
    key = ["role_id", "competency_id", "occurred_on"]
    last = changes.where(F.col("recorded_at") <= F.lit(recorded).cast("timestamp")).groupBy(*key).agg(F.max_by("change_id", F.struct("recorded_at", "change_id")).alias("change_id"))
    return changes.join(last, [*key, "change_id"], "left_semi")
