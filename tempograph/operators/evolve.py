"""Change over time: bursts, trends, lead and lag, inflation, drift, clusters and emerging roles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import first_day
from ..sources.shared import at_most, kept

#: Edges of a graph that are clustered in one task, and entries of a catalogue that every task holds.
AT_ONCE, MAX_ENTRIES = 200_000, 100_000


def bursts(obs: DataFrame, by: list[str], s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """by, start_period, end_period, level, weight: runs of the high state of a two-state automaton, found by one fold over each series."""
    r, d = F.least(F.col("posting_count"), F.greatest(F.col("total_postings"), F.lit(1))).cast("double"), F.greatest(F.col("total_postings"), F.lit(1)).cast("double")
    series = obs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("period", r.alias("r"), d.alias("d")))).alias("x"), F.sum(r).alias("sr"), F.sum(d).alias("sd"), F.count("*").alias("n"))
    series = series.where((F.col("n") >= 2) & (F.col("sr") > 0)).withColumn("p0", F.col("sr") / F.col("sd")).withColumn("p1", s * F.col("p0")).where("p1 < 1")
    cost = lambda e, p: -e["r"] * F.log(p) - (e["d"] - e["r"]) * F.log(1 - p)
    series = series.withColumn("e", F.transform("x", lambda e: F.struct(e["period"].alias("period"), cost(e, F.col("p0")).alias("e0"), cost(e, F.col("p1")).alias("e1"))))
    up = gamma * F.log(F.col("n").cast("double"))
    start = F.struct(F.lit(0.0).alias("c0"), F.lit(float("inf")).alias("c1"), F.lit("").alias("s0"), F.lit("").alias("s1"))

    def step(a: Column, e: Column) -> Column:
        return F.struct(
            (F.least(a["c0"], a["c1"]) + e["e0"]).alias("c0"), (F.least(a["c0"] + up, a["c1"]) + e["e1"]).alias("c1"),
            F.concat(F.when(a["c0"] <= a["c1"], a["s0"]).otherwise(a["s1"]), F.lit("0")).alias("s0"), F.concat(F.when(a["c0"] + up <= a["c1"], a["s0"]).otherwise(a["s1"]), F.lit("1")).alias("s1"))

    path = F.aggregate("e", start, step, lambda a: F.when(a["c0"] <= a["c1"], a["s0"]).otherwise(a["s1"]))
    rows = series.select(*by, path.alias("path"), F.posexplode("e").alias("i", "e")).where(F.substring("path", F.col("i") + 1, F.lit(1)) == "1")
    rows = rows.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*by).orderBy("i")))
    return rows.groupBy(*by, "run").agg(F.min("e.period").alias("start_period"), F.max("e.period").alias("end_period"), F.lit(1).alias("level"), F.sum(F.col("e.e0") - F.col("e.e1")).alias("weight")).drop("run")


def mann_kendall(obs: DataFrame, by: list[str], value: str = "weight") -> DataFrame:
    """by, n, s, var_s, z, slope of series of four points or more: pair signs, tie-corrected variance, Sen's slope."""
    x = obs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("period", F.col(value).cast("double").alias("v")))).alias("x")).where(F.size("x") >= 4)
    x = x.select(*by, F.transform("x", lambda e: e["v"]).alias("v"))
    i, j = F.posexplode("v").alias("i", "a"), F.posexplode("v").alias("j", "b")
    pairs = x.select(*by, "v", i).select(*by, "v", "i", "a", j).where("j > i")
    s = pairs.groupBy(*by).agg(F.sum(F.signum(F.col("b") - F.col("a"))).cast("long").alias("s"), F.median((F.col("b") - F.col("a")) / (F.col("j") - F.col("i"))).alias("slope"))
    ties = F.aggregate(F.transform(F.array_distinct("v"), lambda y: F.size(F.filter("v", lambda w: w == y)).cast("double")), F.lit(0.0), lambda t, k: t + k * (k - 1) * (2 * k + 5))
    n = F.size("v").cast("double")
    v = x.select(*by, F.size("v").cast("long").alias("n"), ((n * (n - 1) * (2 * n + 5) - ties) / 18).alias("var_s"))
    z = F.when((F.col("s") == 0) | (F.col("var_s") <= 0), 0.0).otherwise((F.col("s") - F.signum("s")) / F.sqrt("var_s"))
    return v.join(s, by).withColumn("z", z).select(*by, "n", "s", "var_s", "z", "slope")


#: Two-sided 5 % point of the normal distribution; a trend is one beyond it.
Z = 1.959964


def normal_tail(z: Column) -> Column:
    """2 (1 - Phi(|z|)): by its series up to 3, by the continued fraction of the tail beyond, to 1e-9 and better."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")), lambda a, k: F.struct((a["t"] * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * x * x / (2 * k + 1)).alias("s")), lambda a: a["s"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, k: x + k / a)
    return F.when(z.isNull(), F.lit(None)).when(x <= 3, 1 - 2 * density * terms).otherwise(2 * density / fraction)


def trend_test(obs: DataFrame, by: list[str], value: str = "weight") -> DataFrame:
    """by, n, trend, p_value, slope: Mann-Kendall at 5 %; series of less than four points have no trend, p 1 and slope 0."""
    n = obs.groupBy(*by).agg(F.count("*").alias("n")) if by else obs.agg(F.count("*").alias("n"))
    one = obs if by else obs.withColumn("_all", F.lit(0))
    t = mann_kendall(one, by or ["_all"], value).drop("n")
    j = n.join(t, by, "left") if by else n.join(F.broadcast(t.drop("_all")), F.lit(True), "left")  # one row on either side
    p = F.coalesce(normal_tail(F.col("z")), F.lit(1.0))
    trend = F.when((F.col("z") > 0) & (p < 0.05), "increasing").when((F.col("z") < 0) & (p < 0.05), "decreasing").otherwise("no trend")
    return j.select(*by, F.col("n").cast("long").alias("n"), trend.alias("trend"), p.alias("p_value"), F.coalesce("slope", F.lit(0.0)).alias("slope"))


def classify(trends: DataFrame, burst_rows: DataFrame, by: list[str], z: float = Z) -> DataFrame:
    b = burst_rows.select(*by).distinct().withColumn("bursts", F.lit(True))
    kind = F.when(F.col("z") > z, "growth").when(F.col("z") < -z, "decline").when(F.col("bursts"), "hype").otherwise("stable")
    return trends.join(b, by, "left").select(*by, kind.alias("trend"))


def aligned(leading: DataFrame, lagging: DataFrame, by: list[str]) -> DataFrame:
    """by, period, x, y: weights of periods that both series have, of one version of the ontology if they tell it: that of the last such
    period, of several the largest."""
    own = [c for c in ["ontology_version"] if c in leading.columns and c in lagging.columns]
    of = lambda df, name: df.select(*by, "period", *own, F.col("weight").alias(name))
    both = of(leading, "x").join(of(lagging, "y"), [*by, "period", *own])
    if own:
        last = F.max(F.struct("period", "ontology_version")).over(Window.partitionBy(*by))
        both = both.withColumn("_last", last).where(F.col("ontology_version") == F.col("_last.ontology_version")).drop("_last", "ontology_version")
    return both


def lead_lag(leading: DataFrame, lagging: DataFrame, by: list[str], least: int = 8, widest: int = 8) -> DataFrame:
    """by, lag_periods, correlation, n: the shift of the largest cross-correlation where it reaches 1.96 / sqrt(n)."""
    both = aligned(leading, lagging, by)
    w = Window.partitionBy(*by)
    rows = both.withColumns({"n": F.count("*").over(w), "t": F.row_number().over(w.orderBy("period")), "mx": F.avg("x").over(w), "my": F.avg("y").over(w), "sx": F.stddev_pop("x").over(w), "sy": F.stddev_pop("y").over(w)}).where((F.col("n") >= least) & (F.col("sx") > 0) & (F.col("sy") > 0))
    xs = rows.select(*by, F.col("t").alias("tx"), (F.col("x") - F.col("mx")).alias("dx"), "n", "sx", "sy")
    ys = rows.select(*by, F.col("t").alias("ty"), (F.col("y") - F.col("my")).alias("dy"))
    k = F.col("tx") - F.col("ty")
    c = xs.join(ys, by).where(F.abs(k) <= F.least(F.lit(widest), F.col("n") - 2)).groupBy(*by, k.alias("k"), "n", "sx", "sy").agg(F.sum(F.col("dx") * F.col("dy")).alias("c"))
    c = c.withColumn("correlation", F.round(F.col("c") / (F.col("n") * F.col("sx") * F.col("sy")), 9))
    best = c.withColumn("place", F.row_number().over(w.orderBy(F.desc("correlation"), "k"))).where((F.col("place") == 1) & (F.col("correlation") >= 1.96 / F.sqrt("n")))
    return best.select(*by, (-F.col("k")).cast("long").alias("lag_periods"), "correlation", F.col("n").cast("long").alias("n"))


def f_tail(f: float, a: int, b: int) -> float:
    """P(F > f) for a and b degrees of freedom, by the continued fraction of the incomplete beta function."""
    if f <= 0 or not math.isfinite(f):
        return 1.0 if f <= 0 else 0.0
    x, p, q = b / (b + a * f), b / 2, a / 2

    def beta(x: float, p: float, q: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / ((1 - (p + q) * x / (p + 1)) or tiny)
        h = d
        for m in range(1, 300):
            for t in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / ((1 + t * d) or tiny)
                c = (1 + t / c) or tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h * math.exp(p * math.log(x) + q * math.log(1 - x) + math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q)) / p

    return beta(x, p, q) if x < (p + 1) / (p + q + 2) else 1 - beta(1 - x, q, p)


def granger(leading: DataFrame, lagging: DataFrame, by: list[str], lags: DataFrame, least: int = 8, widest: int = 8) -> DataFrame:
    """by, lag_order, p_value of the F test that lags of x don't help to explain y; 1 where it can't be computed.

    lags is (by, lag_periods) of the pairs that lead; the order is the lag, at least 1, and at most widest, n - 2 and a fifth of n.
    """
    both = aligned(leading, lagging, by).join(lags.select(*by, "lag_periods"), by)

    def test(rows):
        import numpy as np
        import pandas as pd

        rows = rows.sort_values("period")
        x, y, n = rows["x"].to_numpy(), rows["y"].to_numpy(), len(rows)
        k, p = max(1, min(int(rows["lag_periods"].iloc[0]), widest, n - 2, n // 5 or 1)), 1.0
        free = n - 3 * k - 1
        if n >= least and free > 0:
            shifted = lambda v: np.column_stack([v[k - i - 1 : n - i - 1] for i in range(k)])
            left = lambda m: float(((y[k:] - m @ np.linalg.lstsq(m, y[k:], rcond=None)[0]) ** 2).sum())
            small = np.column_stack([np.ones(n - k), shifted(y)])
            r, u = left(small), left(np.column_stack([small, shifted(x)]))
            p = f_tail((r - u) / k / (u / free), k, free) if u > 0 else 1.0
        return pd.DataFrame([[*rows[by].iloc[0], k, float(p)]], columns=[*by, "lag_order", "p_value"])

    kinds = dict(both.dtypes)
    return both.groupBy(*by).applyInPandas(test, ", ".join(f"{b} {kinds[b]}" for b in by) + ", lag_order int, p_value double")


def not_leading(obs: DataFrame, excluded: list[str]) -> DataFrame:
    """Observations without the sources that can't lead; names are compared in lower case with _ for blanks."""
    return obs.where(~F.replace(F.lower(F.trim("source_id")), F.lit(" "), F.lit("_")).isin(excluded)) if excluded else obs


def inflation_series(loads: DataFrame) -> DataFrame:
    """period, n_postings, skills_per_posting, density (mentions a character); 0 where nothing is divided by."""
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    return loads.select("period", "n_postings", share("n_skill_mentions", "n_postings").alias("skills_per_posting"), share("n_skill_mentions", "total_text_chars").alias("density"))


def inflation_report(loads: DataFrame) -> DataFrame:
    """One row: trend and p of skills a posting and of density, Sen's slope of density, and whether mentions are inflated.

    They are if density rises with a p below 5 %: longer texts alone are no inflation. Constant series have no trend.
    """
    s = inflation_series(loads)

    def of(value: str, name: str) -> DataFrame:
        t = trend_test(s, [], value)
        varies = s.agg((F.min(value) != F.max(value)).alias("varies"))
        t = t.join(F.broadcast(varies), F.lit(True))  # one row each
        keep = F.coalesce(F.col("varies"), F.lit(False))
        return t.select(F.when(keep, F.col("trend")).otherwise("no trend").alias(f"{name}_trend"), F.when(keep, F.col("p_value")).otherwise(1.0).alias(f"{name}_p_value"), F.when(keep, F.col("slope")).otherwise(0.0).alias(f"{name}_slope"))

    both = of("skills_per_posting", "posting").drop("posting_slope").join(F.broadcast(of("density", "density")), F.lit(True))  # one row each
    return both.withColumn("inflated", (F.col("density_trend") == "increasing") & (F.col("density_p_value") < 0.05))


def inflation(loads: DataFrame) -> DataFrame:
    """period, skills_per_posting, per_kchars, n_postings, adjustment: the first positive density over the period's, if inflated, else 1."""
    w = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a period
    rows = inflation_series(loads).join(F.broadcast(inflation_report(loads).select("inflated")), F.lit(True), "left")  # one row
    first = F.first(F.when(F.col("density") > 0, F.col("density")), ignorenulls=True).over(w)
    return rows.select("period", "skills_per_posting", (1000 * F.col("density")).alias("per_kchars"), "n_postings", F.when(F.col("inflated") & (F.col("density") > 0), first / F.col("density")).otherwise(1.0).alias("adjustment"))


def deflate(obs: DataFrame, points: DataFrame) -> DataFrame:
    return obs.join(points.select("period", "adjustment"), "period", "left").withColumn("weight", F.col("weight") * F.coalesce("adjustment", F.lit(1.0))).drop("adjustment")


def firm_effects(panel: DataFrame) -> DataFrame:
    """company, role_id, deviation, n_periods: mean distance of a firm's number of skills from that of all its period's rows."""
    rows = panel.withColumn("market", F.avg("n_skills").over(Window.partitionBy("period")))
    return rows.groupBy("company", "role_id").agg(F.avg(F.col("n_skills") - F.col("market")).alias("deviation"), F.count("*").alias("n_periods"))


def drift(before: DataFrame, after: DataFrame, floor: float = 0.05, change: float = 0.3) -> DataFrame:
    """Skills (role_id, skill_id, weight, period) that came above the floor, fell below it, or changed by a share.

    Only roles that both slices have are compared, and where rows tell their version of the ontology, only roles that both slices have
    in one and the same. A change occurs on the first day of the role's last period. Weights below the floor count as absent, but are
    told. reason says what has changed.
    """
    if "ontology_version" in before.columns and "ontology_version" in after.columns:
        versions = before.select("role_id", "ontology_version").union(after.select("role_id", "ontology_version")).groupBy("role_id")
        one = versions.agg(F.min("ontology_version").eqNullSafe(F.max("ontology_version")).alias("_one")).where("_one").select("role_id")
        before, after = before.join(one, "role_id", "left_semi"), after.join(one, "role_id", "left_semi")
    roles = before.select("role_id").distinct().join(after.groupBy("role_id").agg(F.max("period").alias("after_period")), "role_id")
    of = lambda df, name: df.groupBy("role_id", "skill_id").agg(F.max_by("weight", "period").alias(name))
    j = of(before, "w0").join(of(after, "w1"), ["role_id", "skill_id"], "full_outer").join(roles, "role_id")
    w0, w1 = F.coalesce("w0", F.lit(0.0)), F.coalesce("w1", F.lit(0.0))
    was, is_ = w0 >= floor, w1 >= floor
    kind = F.when(~was & is_, "added").when(was & ~is_, "removed").when(was & is_ & (F.abs(w1 - w0) / F.greatest(F.abs(w0), F.lit(1e-9)) >= change), "modified")
    j = j.withColumn("kind", kind).where("kind is not null")
    return j.select(F.concat_ws("-", F.lit("chg"), "role_id", "skill_id", "kind", "after_period").alias("change_id"), "role_id", "skill_id", "kind", F.when(was, w0).alias("before_weight"), F.when(is_, w1).alias("after_weight"), first_day(F.col("after_period")).cast("string").alias("occurred_on"), _reason(w0, w1, floor).alias("reason"))


def _reason(w0: Column, w1: Column, floor: float) -> Column:
    """What a change says, of kind, skill_id and after_period; the sentences are fixed values."""
    two = lambda w: F.format_string("%.2f", F.bround(w, 2))
    share = F.concat(F.bround(F.abs(w1 - w0) / F.greatest(F.abs(w0), F.lit(1e-9)) * 100, 0).cast("long").cast("string"), F.lit("%"))
    skill = F.concat(F.lit("技能点 "), "skill_id")
    new = F.concat(skill, F.lit(" 在 "), "after_period", F.lit(" 首次达到显著重要度 （"), two(w1), F.lit(f"），上一时间片不存在或低于噪声地板 {floor}"))
    gone = F.concat(skill, F.lit(" 在 "), "after_period", F.lit(" 从岗位能力要求中消失（此前重要度 "), two(w0), F.lit("）"))
    other = F.concat(skill, F.lit(" 重要度由 "), two(w0), F.lit(" 变为 "), two(w1), F.lit("（相对变化 "), share, F.lit("）"))
    return F.when(F.col("kind") == "added", new).when(F.col("kind") == "removed", gone).otherwise(other)


def pooled(edges: DataFrame, *keys: str) -> DataFrame:
    """keys, a < b, weight: edges in either direction added up, without loops and without weights of 0 or less."""
    e = edges.where("a <> b and weight > 0").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    return e.groupBy(*keys, "a", "b").agg(F.sum("weight").alias("weight"))


def within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """edges with cluster_id, of those that have both ends in one cluster."""
    ends = lambda name: members.select("cluster_id", F.col("skill_id").alias(name))
    return edges.join(ends("a"), "a").join(ends("b"), ["cluster_id", "b"])


def cluster_density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, n, density: weight inside over the number of pairs; members is (cluster_id, skill_id), edges (a, b, weight).

    Only members that the graph has count.
    """
    e = pooled(edges)
    known = e.select(F.explode(F.array("a", "b")).alias("skill_id")).distinct()
    n = members.join(known, "skill_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n"))
    inside = within(e, members).groupBy("cluster_id").agg(F.sum("weight").alias("w"))
    sizes = members.select("cluster_id").distinct().join(n, "cluster_id", "left").join(inside, "cluster_id", "left")
    n = F.coalesce("n", F.lit(0))
    return sizes.select("cluster_id", n.cast("long").alias("n"), F.when(n < 2, 0.0).otherwise(F.coalesce("w", F.lit(0)) * 2.0 / (n * (n - 1))).alias("density"))


def _seeded(*keys, seed: int) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def _moved(edges: DataFrame, resolution: float, seed: int, rounds: int) -> DataFrame:
    """node, part: nodes moved to the part around them that gains most, in rounds, until none moves.

    In a round only nodes of one colour (half of them, by a hash of node and round) may move, so that neighbours seldom change places;
    and a node that is alone goes to another one that is alone only if that has the smaller name. edges is (src, dst, weight), both
    ways, loops once.
    """
    total = edges.agg(F.sum("weight")).first()[0] or 1.0
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("degree"))
    state, still = kept(degree.select("node", F.col("node").alias("part"), "degree")), 0
    links = edges.where("src <> dst")
    if links.isEmpty():
        return state.drop("degree")

    def moves(state: DataFrame, k: int, colour: int) -> DataFrame:
        """node, to: the nodes of a colour of round k that gain by a move. Links of the others are left where they are."""
        mine = lambda c: F.pmod(_seeded(c, seed=seed + k), F.lit(2)) == colour
        may = state.where(mine("node"))
        parts = state.groupBy(F.col("part").alias("to")).agg(F.sum("degree").alias("sum"), F.count("*").alias("size"))
        near = links.where(mine("src")).join(state.select(F.col("node").alias("dst"), F.col("part").alias("to")), "dst").select(F.col("src").alias("node"), "to", F.col("weight").alias("links"))
        own = may.select("node", F.col("part").alias("to"), F.lit(0.0).alias("links"))
        both = near.unionByName(own).groupBy("node", "to").agg(F.sum("links").alias("links")).join(parts, "to").join(may, "node")
        home = F.col("to") == F.col("part")
        gain = F.col("links") - resolution * (F.col("sum") - F.when(home, F.col("degree")).otherwise(0.0)) * F.col("degree") / total
        swap = ~home & (F.col("size") == 1) & (F.col("to") > F.col("part"))  # if the node is alone, too
        move = F.struct(gain.alias("gain"), home.alias("home"), "to")
        best = both.groupBy("node").agg(F.max(move).alias("any"), F.max(F.when(~swap, move)).alias("alone"), F.max(F.when(home, gain)).alias("stay"), F.max(F.when(home, F.col("size"))).alias("own_size"))
        best = best.select("node", "stay", F.when(F.col("own_size") == 1, F.col("alone")).otherwise(F.col("any")).alias("best"))
        return best.where(F.col("best.gain") > F.col("stay") + 1e-9 * total).select("node", F.col("best.to").alias("to"))

    for k in range(rounds):
        moved = kept(moves(state, k, 0))
        if moved.isEmpty():
            still += 1
            if still == 3 or (still == 1 and moves(state, k, 1).isEmpty()):  # the other colour stays, too: no round changes anything
                break
            continue
        still = 0
        state = kept(state.join(moved, "node", "left").select("node", F.coalesce("to", "part").alias("part"), "degree"))
    return state.drop("degree")


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> float:
    """How much more weight lies within clusters than by chance; edges (a, b, weight), members (cluster_id, skill_id)."""
    e = pooled(edges)
    total = e.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    ends = e.select(F.explode(F.array("a", "b")).alias("skill_id"), "weight").groupBy("skill_id").agg(F.sum("weight").alias("degree"))
    chance = members.join(ends, "skill_id").groupBy("cluster_id").agg(F.sum("degree").alias("d")).agg(F.sum((F.col("d") / (2 * total)) ** 2)).first()[0] or 0.0
    inside = within(e, members).agg(F.sum("weight")).first()[0] or 0.0
    return inside / total - resolution * chance


def communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42, rounds: int = 24, levels: int = 12) -> DataFrame:
    """cluster_id, skill_id by modularity, for graphs of any size: nodes move in rounds of joins, then parts become the nodes of a smaller graph.

    The result isn't that of one task that visits node by node, but of like modularity.
    """
    e = pooled(edges)
    graph = kept(e.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").union(e.select("b", "a", "weight")))
    members = kept(graph.select(F.col("src").alias("skill_id"), F.col("src").alias("node")).distinct())
    n = members.count()
    for level in range(levels):
        moved = _moved(graph, resolution, seed + 1000 * level, rounds)
        members = kept(members.join(moved, "node").select("skill_id", F.col("part").alias("node")))
        now = moved.select("part").distinct().count()
        if now == n:
            break
        n = now
        ends = lambda name: moved.select(F.col("node").alias(name), F.col("part").alias(f"{name}_part"))  # noqa: B023, E731
        graph = kept(graph.join(ends("src"), "src").join(ends("dst"), "dst").groupBy(F.col("src_part").alias("src"), F.col("dst_part").alias("dst")).agg(F.sum("weight").alias("weight")))
    sizes = members.groupBy("node").agg(F.count("*").alias("n"), F.min("skill_id").alias("least"))
    named = sizes.select("node", F.concat(F.lit("cluster-"), (F.row_number().over(Window.orderBy(F.desc("n"), "least")) - 1).cast("string")).alias("cluster_id"))  # one row a cluster
    return members.join(named, "node").select("cluster_id", "skill_id")


def louvain(edges: DataFrame, resolution: float = 1.0, at_once: int = AT_ONCE) -> DataFrame:
    """cluster_id, skill_id by modularity; nodes are visited in sorted order, in one task. A graph of more than `at_once` edges is clustered
    by rounds of joins."""
    edges = kept(edges.select("a", "b", "weight"))
    if edges.count() > at_once:
        return communities(edges, resolution)

    def cluster(rows):
        import pandas as pd

        weight: dict[tuple[str, str], float] = {}
        for a, b, w in zip(rows["a"], rows["b"], rows["weight"]):
            if a != b and w > 0:
                weight[min(a, b), max(a, b)] = weight.get((min(a, b), max(a, b)), 0.0) + w
        total = sum(weight.values())
        groups = {x: [x] for x in sorted({x for e in weight for x in e})}
        while total:
            near: dict[str, dict[str, float]] = {x: {} for x in groups}
            degree = dict.fromkeys(groups, 0.0)
            for (a, b), w in weight.items():
                degree[a] += w
                degree[b] += w
                if a != b:
                    near[a][b], near[b][a] = w, w
            of, sums, moved = {x: x for x in groups}, dict(degree), True
            while moved:  # each move raises modularity by more than rounding, so it ends
                moved = False
                for x in sorted(groups):
                    own, links = of[x], {}
                    for y, w in near[x].items():
                        links[of[y]] = links.get(of[y], 0.0) + w
                    sums[own] -= degree[x]
                    gain = lambda c: links.get(c, 0.0) - resolution * sums[c] * degree[x] / (2 * total)  # noqa: B023, E731
                    best = min(sorted({own, *links}), key=lambda c: (-gain(c), c))  # noqa: B023
                    if gain(best) <= gain(own) + 1e-9 * total:
                        best = own
                    sums[best] += degree[x]
                    if best != own:
                        of[x], moved = best, True
            if all(of[x] == x for x in groups):
                break
            merged: dict[str, list[str]] = {}
            for x, g in groups.items():
                merged.setdefault(of[x], []).extend(g)
            again: dict[tuple[str, str], float] = {}
            for (a, b), w in weight.items():
                k = (min(of[a], of[b]), max(of[a], of[b]))
                again[k] = again.get(k, 0.0) + w
            groups, weight = merged, again
        ordered = sorted((sorted(g) for g in groups.values()), key=lambda g: (-len(g), g))
        return pd.DataFrame([(f"cluster-{i}", x) for i, g in enumerate(ordered) for x in g], columns=["cluster_id", "skill_id"])

    return edges.groupBy(F.lit("all").alias("group")).applyInPandas(cluster, "cluster_id string, skill_id string")


def recent_edges(edges: DataFrame, current: str | None = None, last: int = 4) -> DataFrame:
    """edges (period, ...) up to the current period, if they have it, with is_recent: in one of the last periods that they have."""
    periods = edges.select("period").distinct()
    if current is not None:
        has = periods.agg(F.max((F.col("period") == current).cast("int")).alias("has"))
        periods = periods.join(F.broadcast(has), (F.col("has") != 1) | (F.col("period") <= current)).select("period")  # one row
    place = F.dense_rank().over(Window.orderBy(F.desc("period")))  # one row a period
    return edges.join(F.broadcast(periods.select("period", (place <= last).alias("is_recent"))), "period")


def catalogue_hits(members: DataFrame, names: DataFrame, catalogue: DataFrame, distance: float = 0.4) -> DataFrame:
    """cluster_id, code: the first entry of a catalogue (code, name, skill_ids) that a cluster is near to by skills or that shares its name.

    names is (cluster_id, name). Names are compared without blanks and in lower case; one may hold the other. Names of clusters are
    streamed past those of the catalogue, which may have MAX_ENTRIES.
    """
    catalogue = at_most(catalogue, MAX_ENTRIES, "entries of a catalogue")
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    entries = catalogue.select("code", F.explode("skill_ids").alias("skill_id")).distinct()
    common = members.join(entries, "skill_id").groupBy("cluster_id", "code").agg(F.count("*").alias("common"))
    near = common.join(entries.groupBy("code").agg(F.count("*").alias("n")), "code").join(size, "cluster_id").where(1 - F.col("common") / (F.col("n") + F.col("size") - F.col("common")) < distance).select("cluster_id", "code")
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    named = names.select("cluster_id", plain(F.col("name")).alias("x")).where("x <> ''").crossJoin(F.broadcast(catalogue.select("code", plain(F.col("name")).alias("y")).where("y <> ''")))
    return near.union(named.where(F.contains("x", "y") | F.contains("y", "x")).select("cluster_id", "code")).groupBy("cluster_id").agg(F.min("code").alias("code"))


def emerging_gates(members: DataFrame, edges: DataFrame, burst_skills: DataFrame, roles: DataFrame, catalogue: DataFrame | None = None, names: DataFrame | None = None, ratio: float = 2.0, distance: float = 0.4) -> DataFrame:
    """Of each cluster the gates in order (new, bursting, two sources, far from roles, in no catalogue), the first that fails, strength,
    zone and evidence_count.

    edges is (source_id, a, b, weight, is_recent), roles (role_id, skill_id), names (cluster_id, name). A source sees a cluster if its recent
    edges touch half of its skills, two at least, and one lies within. The edges are pooled once and read again.
    """
    return _gates(members, kept(pooled_sources(edges)), burst_skills, roles, catalogue, names, ratio, distance)


def pooled_sources(edges: DataFrame) -> DataFrame:
    """is_recent, source_id, a <= b, weight: edges of recent periods and of others, added up by source."""
    return edges.groupBy("is_recent", "source_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0)).alias("weight"))


def _gates(members: DataFrame, e: DataFrame, burst_skills: DataFrame, roles: DataFrame, catalogue: DataFrame | None, names: DataFrame | None, ratio: float = 2.0, distance: float = 0.4) -> DataFrame:
    now, then = cluster_density(e.where("is_recent"), members), cluster_density(e.where("not is_recent"), members).select("cluster_id", F.col("density").alias("was"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    burst = members.join(burst_skills.distinct(), "skill_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n_bursts"))
    touched = e.where("is_recent").select("source_id", F.explode(F.array("a", "b")).alias("skill_id")).distinct()
    covered = touched.join(members, "skill_id").groupBy("cluster_id", "source_id").agg(F.count("*").alias("covered")).join(size, "cluster_id")
    inside = within(e.where("is_recent"), members)
    sources = covered.where(F.col("covered") >= F.greatest(F.lit(2), F.floor(0.5 * F.col("size") + 0.999))).join(inside.select("cluster_id", "source_id"), ["cluster_id", "source_id"], "left_semi").groupBy("cluster_id").agg(F.count("*").alias("n_sources"))
    links = inside.where("a <> b and weight > 0").select("cluster_id", "a", "b").distinct().groupBy("cluster_id").agg(F.count("*").alias("n_links"))
    role_size = roles.groupBy("role_id").agg(F.count("*").alias("role_size"))
    common = members.join(roles, "skill_id").groupBy("cluster_id", "role_id").agg(F.count("*").alias("common")).join(role_size, "role_id").join(size, "cluster_id")
    near = common.groupBy("cluster_id").agg(F.min(1 - F.col("common") / (F.col("role_size") + F.col("size") - F.col("common"))).alias("d"))
    t = now.join(then, "cluster_id").join(size, "cluster_id")
    for other in (burst, sources, links, near):
        t = t.join(other, "cluster_id", "left")
    t = t.na.fill({"n_bursts": 0, "n_sources": 0, "n_links": 0, "d": 1.0})
    hits = catalogue_hits(members, names, catalogue, distance) if catalogue is not None and names is not None else None
    t = t.join(hits, "cluster_id", "left") if hits is not None else t.withColumn("code", F.lit(None).cast("string"))
    t = t.withColumn("density_ratio", F.when(F.col("was") > 0, F.col("density") / F.col("was")).when(F.col("density") > 0, 99.0).otherwise(0.0))
    failed = F.when(F.col("density_ratio") < ratio, "not_new").when(F.col("n_bursts") < 2, "few_bursts").when(F.col("n_sources") < 2, "one_source").when(F.col("d") < distance, "near_role").when(F.col("code").isNotNull(), "in_catalogue")
    score = F.when(F.col("density_ratio") >= 99, 1.0).when(F.col("density_ratio") <= 1, 0.0).otherwise(F.least(F.log2("density_ratio") / 2, F.lit(1.0)))
    strength = (F.col("n_bursts") / F.col("size") + F.least(F.col("n_sources") / 3, F.lit(1.0)) + F.least(F.col("d") / 0.8, F.lit(1.0)) + score) / 4
    t = t.withColumn("failed_gate", failed).withColumn("strength", strength)
    whole = lambda c: F.col(c).cast("long").alias(c)
    return t.select("cluster_id", whole("size"), "density_ratio", whole("n_bursts"), whole("n_sources"), F.col("d").alias("min_distance"), F.col("code").alias("catalogue_code"), "failed_gate", "strength", F.when(F.col("strength") >= 0.65, "publish").otherwise("watch").alias("zone"), (F.col("n_sources") + F.col("n_bursts") + F.col("n_links")).cast("long").alias("evidence_count"))


def discover_emerging(edges: DataFrame, burst_skills: DataFrame, roles: DataFrame, catalogue: DataFrame, version: str, current: str | None = None, least: int = 3) -> DataFrame:
    """role_id, name, skill_ids, zone, state, strength, evidence_count: clusters of recent edges (source_id, period, a, b, weight) that pass
    all gates, the strongest first. The edges are read and pooled once, for the clusters and for the gates."""
    flagged = kept(pooled_sources(recent_edges(edges, current)))
    found = louvain(pooled(flagged.where("is_recent")))
    members = kept(found.withColumn("n", F.count("*").over(Window.partitionBy("cluster_id"))).where(F.col("n") >= least).select("cluster_id", "skill_id"))
    ids = members.groupBy("cluster_id").agg(F.sort_array(F.collect_list("skill_id")).alias("skill_ids")).withColumn("name", F.array_join(F.slice("skill_ids", 1, 3), "-"))
    passed = _gates(members, flagged, burst_skills, roles, catalogue, ids).where("failed_gate is null").join(ids, "cluster_id")
    role = F.concat(F.lit("cand-"), F.substring(F.md5(F.concat(F.lit(f"{version}:"), F.array_join("skill_ids", ",")).cast("binary")), 1, 12))
    state = F.when(F.col("zone") == "publish", "held").otherwise("unverified")
    return passed.select(role.alias("role_id"), "name", "skill_ids", "zone", state.alias("state"), "strength", "evidence_count").orderBy("zone", F.desc("strength"), "role_id")
