"""Questions to the temporal role-skill graph, as joins over its edge tables."""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import check_period, last_day
from ..sources.shared import kept

#: Candidate edges that are chosen from in one task.
AT_ONCE = 200_000

#: Weight bands of the tiers, half-open.
TIERS = {"high": (0.7, 1.01), "medium": (0.3, 0.7), "low": (0.0, 0.3)}


def slice_of(obs: DataFrame, period: str) -> DataFrame:
    return obs.where(F.col("period") == check_period(period))


def band(weight: Column, low: float, high: float) -> Column:
    return (weight >= low) & (weight < high)


def panorama(obs: DataFrame, period: str, low: float = 0.0, high: float = 1.01, limit: int = 200) -> DataFrame:
    """The heaviest edges of a slice within a weight band."""
    return slice_of(obs, period).where(band(F.col("weight"), low, high)).orderBy(F.desc("weight"), "role_id", "skill_id").limit(limit).select("role_id", "skill_id", "weight")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("role_id").alias("node_id"), F.lit("role").alias("kind")).union(edges.select("skill_id", F.lit("skill"))).distinct()


def capped(edges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The first nodes, and the edges that have both ends among them."""
    first = nodes(edges).orderBy("kind", "node_id").limit(limit)
    ids = lambda kind, name: first.where(F.col("kind") == kind).select(F.col("node_id").alias(name))
    return first, edges.join(ids("role", "role_id"), "role_id", "left_semi").join(ids("skill", "skill_id"), "skill_id", "left_semi")


def competency_diff(obs: DataFrame, covers: DataFrame, a: str, b: str) -> DataFrame:
    """Competencies whose map of skill weights is new, gone or different at all; covers is (skill_id, competency)."""
    work = obs.where(F.col("period").isin(check_period(a), check_period(b))).join(covers, "skill_id", "left")
    key = F.coalesce("competency", F.concat(F.lit("skill:"), "skill_id"))
    maps = work.groupBy("role_id", key.alias("competency"), "period").agg(F.array_sort(F.collect_list(F.struct("skill_id", F.round("weight", 6).alias("weight")))).alias("w"))
    left = maps.where(F.col("period") == a).select("role_id", "competency", F.col("w").alias("before"))
    right = maps.where(F.col("period") == b).select("role_id", "competency", F.col("w").alias("after"))
    kind = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "modified")
    d = left.join(right, ["role_id", "competency"], "full_outer").withColumn("kind", kind).where("kind is not null")
    return d.select(
        F.concat_ws(":", "role_id", "competency", F.lit(a), F.lit(b), "kind").alias("change_id"), "role_id", "competency", "kind", last_day(F.lit(b)).cast("string").alias("occurred_on"),
        F.coalesce(F.size("before"), F.lit(0)).cast("long").alias("n_before"), F.coalesce(F.size("after"), F.lit(0)).cast("long").alias("n_after"))


def role_panorama(obs: DataFrame, covers: DataFrame, role: str, period: str) -> DataFrame:
    """Competencies of a role with the skills they cover; skills without one are under `uncovered`."""
    work = slice_of(obs, period).where(F.col("role_id") == role).join(covers, "skill_id", "left")
    return work.select(F.coalesce("competency", F.lit("uncovered")).alias("competency"), "skill_id", "weight")


def compare_roles(obs: DataFrame, a: str, b: str, period: str) -> DataFrame:
    s = slice_of(obs, period)
    left = s.where(F.col("role_id") == a).select("skill_id", F.col("weight").alias("weight_a"))
    right = s.where(F.col("role_id") == b).select("skill_id", F.col("weight").alias("weight_b"))
    side = F.when(F.col("weight_b").isNull(), "only_a").when(F.col("weight_a").isNull(), "only_b").otherwise("both")
    return left.join(right, "skill_id", "full_outer").select("skill_id", side.alias("side"), "weight_a", "weight_b", F.round(F.col("weight_b") - F.col("weight_a"), 6).alias("delta"))


def cooccurrence(edges: DataFrame, skill: str, limit: int = 200) -> DataFrame:
    """skill_id, shared_roles, max_weight of the skills that share roles with one."""
    roles = edges.where(F.col("skill_id") == skill).select("role_id").distinct()
    near = edges.join(roles, "role_id", "left_semi").where(F.col("skill_id") != skill)
    return near.groupBy("skill_id").agg(F.count_distinct("role_id").alias("shared_roles"), F.max("weight").alias("max_weight")).orderBy(F.desc("shared_roles"), "skill_id").limit(limit)


def cooccurrence_two_hops(edges: DataFrame, skill: str, limit: int = 200) -> DataFrame:
    """via, hop1, skill_id, hop2: the neighbours of all neighbours, and in how many roles each step is."""
    e = edges.select("role_id", "skill_id").distinct()
    roles = e.where(F.col("skill_id") == skill).select("role_id")
    via = e.join(roles, "role_id", "left_semi").where(F.col("skill_id") != skill).groupBy(F.col("skill_id").alias("via")).agg(F.count("*").alias("hop1"))
    of = e.join(via, e.skill_id == via.via).select("role_id", "via", "hop1")
    far = of.join(e, "role_id").where((F.col("skill_id") != F.col("via")) & (F.col("skill_id") != skill))
    return far.groupBy("via", "hop1", "skill_id").agg(F.count("*").alias("hop2")).orderBy(F.desc("hop1"), F.desc("hop2"), "via", "skill_id").limit(limit)


def pair_counts(edges: DataFrame) -> DataFrame:
    """a < b and the number of roles that have both."""
    e = edges.select("role_id", "skill_id").distinct()
    right = e.select("role_id", F.col("skill_id").alias("b"))
    return e.withColumnRenamed("skill_id", "a").join(right, "role_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both"))


def prerequisites_by_hierarchy(parents: DataFrame, confidence: float = 0.9) -> DataFrame:
    """parents is (skill_id, parent_id): the parent comes before the child."""
    rows = parents.where("parent_id is not null and parent_id <> skill_id")
    return rows.select(F.col("parent_id").alias("src"), F.col("skill_id").alias("dst"), F.lit("hierarchy").alias("rule"), F.lit(confidence).alias("confidence"))


def prerequisites_by_asymmetry(edges: DataFrame, least: int = 3, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """Of two skills, the one that nearly always comes along but is common by itself comes before."""
    n = edges.select("role_id", "skill_id").distinct().groupBy("skill_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    left, right = n.select(F.col("skill_id").alias("a"), F.col("n").alias("n_a")), n.select(F.col("skill_id").alias("b"), F.col("n").alias("n_b"))
    p = pair_counts(edges).join(left, "a").join(right, "b").withColumns({"b_given_a": F.col("both") / F.col("n_a"), "a_given_b": F.col("both") / F.col("n_b")})
    forward, back = (F.col("b_given_a") >= high) & (F.col("a_given_b") <= low), (F.col("a_given_b") >= high) & (F.col("b_given_a") <= low)
    p = p.where(forward | back)
    return p.select(F.when(forward, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(forward, F.col("a")).otherwise(F.col("b")).alias("dst"), F.lit("asymmetry").alias("rule"), F.least(F.lit(1.0), F.abs(F.col("b_given_a") - F.col("a_given_b"))).alias("confidence"))


#: What marks a role's name as junior or senior.
JUNIOR = ["初级", "实习", "助理", "junior", "intern", "assistant"]
SENIOR = ["高级", "资深", "专家", "架构", "senior", "staff", "principal", "architect"]


def role_band(name: Column) -> Column:
    """junior or senior, if the name has marks of one of them only; else null."""
    low = F.lower(F.coalesce(name, F.lit("")))
    junior, senior = (F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(low, m)) for marks in (JUNIOR, SENIOR))
    return F.when(junior & ~senior, "junior").when(senior & ~junior, "senior")


def prerequisites_by_seniority(rows: DataFrame, least: int = 2, share: float = 0.6, gap: float = 0.3) -> DataFrame:
    """rows is (skill_id, band), one a role: of any two skills, the one of junior roles comes before the one of senior roles.

    Shares meet by steps of 0.05, so that the join is one on a key.
    """
    n = rows.where(F.col("band").isin("junior", "senior")).groupBy("skill_id").agg(F.count("*").alias("n"), F.avg((F.col("band") == "junior").cast("double")).alias("junior")).where(F.col("n") >= least)
    step = lambda c: F.floor(c * 20).cast("int")
    a = n.where(F.col("junior") >= share).select(F.col("skill_id").alias("src"), F.col("junior").alias("j"), F.explode(F.sequence(F.lit(0), step(F.col("junior") - gap) + 1)).alias("step"))
    b = n.where(1 - F.col("junior") >= share).select(F.col("skill_id").alias("dst"), F.col("junior").alias("dj"), step(F.col("junior")).alias("step"))
    met = a.join(b, "step").where((F.col("j") - F.col("dj") >= gap) & (F.col("src") != F.col("dst")))
    return met.select("src", "dst", F.lit("seniority").alias("rule"), F.least(F.lit(0.8), F.col("j") - F.col("dj")).alias("confidence"))


#: Which rule's edges are taken first.
RULE_ORDER = {"manual": 0, "hierarchy": 1, "asymmetry": 2, "seniority": 3}


def acyclic(src: list[int], dst: list[int], n: int) -> list[bool]:
    """Which of the edges, taken in order, stay: those that repeat none and close no cycle with the ones before.

    A topological order of the n nodes is kept up. An edge that agrees with it stays at once. Another one may close a cycle or bend
    the order only between its ends. There nodes behind its head and nodes before its tail are looked up by turns: if they meet,
    it closes a cycle; as soon as one side has no more, that side moves past the other end.
    """
    order, at = array("q", range(n)), np.arange(n)
    places = np.frombuffer(order, np.int64) if n else at  # the same memory
    after, before, there, stays = [[] for _ in range(n)], [[] for _ in range(n)], set(), []
    for a, b in zip(src, dst):
        ok = a != b and (a, b) not in there
        if ok and order[b] < order[a]:
            low, high = order[b], order[a]
            behind, ahead, seen, met, i, j, cost = [b], [a], {b}, {a}, 0, 0, 0
            while ok and i < len(behind) and j < len(ahead):
                if cost <= 0:
                    near = after[behind[i]]
                    i, cost = i + 1, cost + len(near) + 1
                    for y in near:
                        if y in met:
                            ok = False
                            break
                        if y not in seen and order[y] < high:
                            seen.add(y)
                            behind.append(y)
                else:
                    near = before[ahead[j]]
                    j, cost = j + 1, cost - len(near) - 1
                    for y in near:
                        if y in seen:
                            ok = False
                            break
                        if y not in met and order[y] > low:
                            met.add(y)
                            ahead.append(y)
            if ok:
                moved = np.zeros(high - low + 1, bool)
                forward = i == len(behind)
                moved[places[behind if forward else ahead] - low] = True
                part = at[low : high + 1]
                part = np.concatenate([part[~moved], part[moved]] if forward else [part[moved], part[~moved]])
                at[low : high + 1] = part
                places[part] = np.arange(low, high + 1)
        if ok:
            there.add((a, b))
            after[a].append(b)
            before[b].append(a)
        stays.append(ok)
    return stays


def off_cycles(edges: DataFrame, rounds: int = 12) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst, ...) that are surely in no cycle, and the rest: ends of chains are taken away again and again."""
    left, free, n = kept(edges), None, None
    for _ in range(rounds):
        into, out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        inner = kept(left.join(into, "src", "left_semi").join(out, "dst", "left_semi").select(edges.columns))
        outer = left.join(into, "src", "left_anti").unionByName(left.join(into, "src", "left_semi").join(out, "dst", "left_anti"))
        free = outer if free is None else free.unionByName(outer)
        left, before, n = inner, n, inner.count()
        if not n or n == before:
            break
    return free, left


def connected(edges: DataFrame) -> DataFrame:
    """node, part: the smallest node that edges (src, dst), taken in both directions, lead to.

    Each round a node takes the smallest label around it, and then that label's own label, so chains halve.
    """
    both = kept(edges.select(F.col("src").alias("node"), F.col("dst").alias("near")).union(edges.select("dst", "src")).distinct())
    labels, state = kept(both.groupBy("node").agg(F.least("node", F.min("near")).alias("part"))), None
    while True:
        around = both.join(labels.select(F.col("node").alias("near"), "part"), "near").groupBy("node").agg(F.min("part").alias("other"))
        least = labels.join(around, "node").select("node", F.least("part", "other").alias("part"))
        of = labels.select(F.col("node").alias("part"), F.col("part").alias("next"))
        labels = kept(least.join(of, "part").select("node", F.least("part", "next").alias("part")))
        now = labels.agg(F.sum(F.xxhash64("node", "part").cast("decimal(38,0)"))).first()[0]
        if now == state:
            return labels
        state = now


def select_acyclic(candidates: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """Edges in order of rule, confidence and ids, without those that repeat, reverse or close a cycle.

    The choice of an edge depends on those before it, but only on ones it shares a cycle of candidates with. So of more than `at_once`
    candidates, edges off all cycles stay without a look, and the others are chosen by connected parts, each in a task of its own.
    """

    def pick(rows):
        rows = rows.assign(o=rows["rule"].map(RULE_ORDER)).sort_values(["o", "confidence", "src", "dst"], ascending=[True, False, True, True])
        number = {x: i for i, x in enumerate(dict.fromkeys([*rows["src"], *rows["dst"]]))}
        stays = acyclic([number[x] for x in rows["src"]], [number[x] for x in rows["dst"]], len(number))
        return rows.loc[stays, ["src", "dst", "rule", "confidence"]]

    schema = "src string, dst string, rule string, confidence double"
    edges = kept(candidates.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "rule", "confidence").where("src <> dst"))
    if edges.count() <= at_once:
        return edges.groupBy(F.lit("all").alias("group")).applyInPandas(pick, schema)
    rule = F.element_at(F.create_map(*[F.lit(x) for kv in RULE_ORDER.items() for x in kv]), F.col("rule"))
    first = edges.groupBy("src", "dst").agg(F.min(F.struct(rule.alias("o"), (-F.col("confidence")).alias("c"), "rule", "confidence")).alias("e"))
    free, core = off_cycles(first.select("src", "dst", "e.rule", "e.confidence"))
    parts = core.join(connected(core).withColumnRenamed("node", "src"), "src")
    return free.select("src", "dst", "rule", "confidence").unionByName(parts.groupBy("part").applyInPandas(pick, schema))
