"""Queries over observations, the graph and its change, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evolve, graph, observe
from ..schema import period_of
from ..sources.tables import SQL_BASE, mentions, postings, sql_obs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
A, B = "2001Q1", "2001Q2"
ROLE, OTHER = "BUILDING", "MACHINERY"
LEAD, LAG = "1-URGENT", "5-LOW"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def obs(spark: SparkSession, d: str, by: list[str], sparse: bool = False) -> DataFrame:
    return observe.observations(postings(spark, d), mentions(spark, d, sparse), by)


def types(spark: SparkSession, d: str) -> DataFrame:
    """The type that most parts of a brand have, as the competency that covers the brand."""
    n = table(spark, d, "part").groupBy(F.col("p_brand").alias("skill_id"), F.col("p_type").alias("competency")).count()
    return n.groupBy("skill_id").agg(F.max_by("competency", F.struct("count", "competency")).alias("competency"))


RD, RS, GD, GS, SD, CD = sql_obs("rd", "role_id", "md"), sql_obs("rs", "role_id", "ms"), sql_obs("gd", None, "md"), sql_obs("gs", None, "ms"), sql_obs("sd", "source_id", "md"), sql_obs("cd", "company", "md")
TYPES = "types AS (SELECT p_brand AS skill_id, arg_max(p_type, (n, p_type)) AS competency FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join([SQL_BASE, *ctes])


@query(f"{with_(RD)} SELECT * FROM rd")
def obs_role_skill(spark, d):
    return obs(spark, d, ["role_id"])


@query(f"{with_(GD)} SELECT * FROM gd")
def obs_global_skill(spark, d):
    return obs(spark, d, [])


@query(f"{with_(SD)} SELECT * FROM sd")
def obs_source_skill(spark, d):
    return obs(spark, d, ["source_id"])


@query(f"{with_(RD)} SELECT skill_id, period, weight, posting_count FROM rd WHERE role_id = '{ROLE}' AND period = '{B}'")
def role_skills_slice(spark, d):
    return graph.slice_of(obs(spark, d, ["role_id"]), B).where(F.col("role_id") == ROLE).select("skill_id", "period", "weight", "posting_count")


@query(f"{with_(RD)} SELECT role_id, max(period) AS latest_period FROM rd GROUP BY 1")
def latest_period_by_role(spark, d):
    return observe.latest_period(obs(spark, d, ["role_id"]), ["role_id"])


@query(f"{with_(RD)} SELECT skill_id, max(period) AS latest_period FROM rd GROUP BY 1")
def latest_period_by_skill(spark, d):
    return observe.latest_period(obs(spark, d, ["role_id"]), ["skill_id"])


@query(f"{with_(RD)} SELECT role_id, skill_id, weight FROM rd WHERE period = '{B}' ORDER BY weight DESC, role_id, skill_id LIMIT 50")
def panorama_top(spark, d):
    return graph.panorama(obs(spark, d, ["role_id"]), B, limit=50)


@query(f"{with_(RD)} SELECT role_id, skill_id, weight FROM rd WHERE period = '{B}' AND weight >= 0.1 AND weight < 0.2 ORDER BY weight DESC, role_id, skill_id LIMIT 200")
def panorama_tier(spark, d):
    return graph.panorama(obs(spark, d, ["role_id"]), B, 0.1, 0.2)


@query(f"{with_(RD)} SELECT DISTINCT role_id AS node_id, 'role' AS kind FROM rd WHERE period = '{B}' UNION SELECT DISTINCT skill_id, 'skill' FROM rd WHERE period = '{B}'")
def snapshot_nodes(spark, d):
    return graph.nodes(graph.slice_of(obs(spark, d, ["role_id"]), B))


@query(f"{with_(RD)} SELECT role_id, skill_id, weight, posting_count, total_postings FROM rd WHERE period = '{B}'")
def snapshot_requirements(spark, d):
    return graph.slice_of(obs(spark, d, ["role_id"]), B).select("role_id", "skill_id", "weight", "posting_count", "total_postings")


@query(f"""{with_(RS)}, w AS (SELECT role_id, split_part(skill_id, '/', 2) AS competency, period, list((skill_id, round(weight, 6)) ORDER BY skill_id) AS w FROM rs WHERE period IN ('{A}', '{B}') GROUP BY ALL),
j AS (SELECT role_id, competency, a.w AS wa, b.w AS wb FROM (SELECT * FROM w WHERE period = '{A}') a FULL JOIN (SELECT * FROM w WHERE period = '{B}') b USING (role_id, competency)),
k AS (SELECT *, CASE WHEN wa IS NULL THEN 'added' WHEN wb IS NULL THEN 'removed' WHEN wa <> wb THEN 'modified' END AS kind FROM j)
SELECT role_id || ':' || competency || ':{A}:{B}:' || kind AS change_id, role_id, competency, kind, '2001-06-30' AS occurred_on, CAST(coalesce(len(wa), 0) AS BIGINT) AS n_before, CAST(coalesce(len(wb), 0) AS BIGINT) AS n_after FROM k WHERE kind IS NOT NULL""")
def competency_diff(spark, d):
    o = obs(spark, d, ["role_id"], sparse=True)
    return graph.competency_diff(o, o.select("skill_id").distinct().withColumn("competency", F.split_part("skill_id", F.lit("/"), F.lit(2))), A, B)


@query(f"{with_(RD, TYPES)} SELECT coalesce(competency, 'uncovered') AS competency, skill_id, weight FROM rd LEFT JOIN types USING (skill_id) WHERE role_id = '{ROLE}' AND period = '{B}'")
def role_panorama(spark, d):
    return graph.role_panorama(obs(spark, d, ["role_id"]), types(spark, d), ROLE, B)


@query(f"""{with_(RS)}, a AS (SELECT skill_id, weight AS weight_a FROM rs WHERE role_id = '{ROLE}' AND period = '{B}'), b AS (SELECT skill_id, weight AS weight_b FROM rs WHERE role_id = '{OTHER}' AND period = '{B}')
SELECT skill_id, CASE WHEN weight_b IS NULL THEN 'only_a' WHEN weight_a IS NULL THEN 'only_b' ELSE 'both' END AS side, weight_a, weight_b, round(weight_b - weight_a, 6) AS delta FROM a FULL JOIN b USING (skill_id)""")
def compare_roles(spark, d):
    return graph.compare_roles(obs(spark, d, ["role_id"], sparse=True), ROLE, OTHER, B)


EDGES = f"e AS (SELECT company AS role_id, skill_id, weight FROM cd WHERE period = '{B}')"


def edges(spark, d) -> DataFrame:
    return graph.slice_of(obs(spark, d, ["company"]), B).select(F.col("company").alias("role_id"), "skill_id", "weight")


NEAR = "SELECT n.skill_id, count(DISTINCT role_id) AS shared_roles, max(weight) AS max_weight FROM e n WHERE skill_id <> 'Brand#11' AND role_id IN (SELECT role_id FROM e WHERE skill_id = 'Brand#11') GROUP BY 1 ORDER BY 2 DESC, 1"


@query(f"{with_(CD, EDGES)} {NEAR} LIMIT 200")
def cooccur_one_hop(spark, d):
    return graph.cooccurrence(edges(spark, d), "Brand#11")


@query(f"""{with_(CD, EDGES)}, mid AS (SELECT b.skill_id AS via, count(DISTINCT a.role_id) AS hop1 FROM e a JOIN e b USING (role_id) WHERE a.skill_id = 'Brand#11' AND b.skill_id <> 'Brand#11' GROUP BY 1)
SELECT via, hop1, far.skill_id, count(DISTINCT far.role_id) AS hop2 FROM mid JOIN e c ON c.skill_id = via JOIN e far ON far.role_id = c.role_id WHERE far.skill_id <> 'Brand#11' AND far.skill_id <> via GROUP BY ALL ORDER BY hop1 DESC, hop2 DESC, via, far.skill_id LIMIT 200""")
def cooccur_two_hop(spark, d):
    return graph.cooccurrence_two_hops(edges(spark, d), "Brand#11")


PAIRS = "pr AS (SELECT x.skill_id AS a, y.skill_id AS b, count(*) AS both_n FROM (SELECT DISTINCT role_id, skill_id FROM e) x JOIN (SELECT DISTINCT role_id, skill_id FROM e) y ON x.role_id = y.role_id AND x.skill_id < y.skill_id GROUP BY ALL)"


@query(f"{with_(CD, EDGES, PAIRS)} SELECT a, b, both_n AS \"both\" FROM pr")
def pair_counts(spark, d):
    return graph.pair_counts(edges(spark, d))


@query("SELECT DISTINCT p_type AS src, p_type || '/' || p_brand AS dst, 'hierarchy' AS rule, 0.9::DOUBLE AS confidence FROM part")
def prereq_hierarchy(spark, d):
    return graph.prerequisites_by_hierarchy(table(spark, d, "part").select(F.concat_ws("/", "p_type", "p_brand").alias("skill_id"), F.col("p_type").alias("parent_id")).distinct())


ASYM = """an AS (SELECT skill_id, count(*) AS n FROM (SELECT DISTINCT role_id, skill_id FROM e) GROUP BY 1 HAVING count(*) >= 3),
ap AS (SELECT a, b, both_n / x.n AS ba, both_n / y.n AS ab FROM pr JOIN an x ON a = x.skill_id JOIN an y ON b = y.skill_id),
asym AS (SELECT CASE WHEN ba >= 0.14 AND ab <= 0.12 THEN b ELSE a END AS src, CASE WHEN ba >= 0.14 AND ab <= 0.12 THEN a ELSE b END AS dst, 'asymmetry' AS rule, least(1.0, abs(ba - ab)) AS confidence FROM ap
  WHERE (ba >= 0.14 AND ab <= 0.12) OR (ab >= 0.14 AND ba <= 0.12))"""


@query(f"{with_(CD, EDGES, PAIRS, ASYM)} SELECT * FROM asym")
def prereq_asymmetry(spark, d):
    """Thresholds are relaxed: customers of one quarter share few brands."""
    return graph.prerequisites_by_asymmetry(edges(spark, d), high=0.14, low=0.12)


SENIOR = f"""sb AS (SELECT DISTINCT company, skill_id, CASE WHEN c_acctbal < 2000 THEN 'junior' WHEN c_acctbal > 8000 THEN 'senior' END AS band FROM p JOIN ms USING (posting_id) JOIN customer ON company = c_custkey WHERE period = '{B}'),
sn AS (SELECT skill_id, count(*) FILTER (band = 'junior') AS jun, count(*) FILTER (band = 'senior') AS sen FROM sb GROUP BY 1),
sen AS (SELECT a.skill_id AS src, b.skill_id AS dst, 'seniority' AS rule, least(0.8, a.jun / (a.jun + a.sen) - b.jun / (b.jun + b.sen)) AS confidence FROM sn a, sn b
  WHERE a.skill_id <> b.skill_id AND a.jun + a.sen >= 2 AND b.jun + b.sen >= 2 AND a.jun / (a.jun + a.sen) >= 0.6 AND b.sen / (b.jun + b.sen) >= 0.6 AND a.jun / (a.jun + a.sen) - b.jun / (b.jun + b.sen) >= 0.3)"""


@query(f"{with_(SENIOR)} SELECT * FROM sen")
def prereq_seniority(spark, d):
    """Customers as roles; names that mark a band come from their balances."""
    name = F.when(F.col("c_acctbal") < 2000, "Junior buyer").when(F.col("c_acctbal") > 8000, "buyer, PRINCIPAL").otherwise("senior intern")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("company"), graph.role_band(name).alias("band"))
    rows = postings(spark, d).where(F.col("period") == B).join(mentions(spark, d, True), "posting_id").join(c, "company").select("company", "skill_id", "band").distinct()
    return graph.prerequisites_by_seniority(rows)


@query()
def prereq_acyclic(spark, d):
    return graph.select_acyclic(prereq_hierarchy(spark, d).unionByName(prereq_asymmetry(spark, d)).unionByName(prereq_seniority(spark, d)))


def burst_sql(source: str, by: str, name: str) -> str:
    k = f"{by}, " if by else ""
    return f"""{name}_s AS (SELECT {k}skill_id, list({{'period': period, 'r': CAST(least(posting_count, total_postings) AS DOUBLE), 'd': CAST(greatest(total_postings, 1) AS DOUBLE)}} ORDER BY period) AS x, CAST(sum(posting_count) AS DOUBLE) AS sr, CAST(sum(total_postings) AS DOUBLE) AS sd, count(*) AS n FROM {source} GROUP BY ALL),
{name}_e AS (SELECT {k}skill_id, n, list_transform(x, lambda e: {{'period': e.period, 'e0': -e.r * ln(sr / sd) - (e.d - e.r) * ln(1 - sr / sd), 'e1': -e.r * ln(2 * (sr / sd)) - (e.d - e.r) * ln(1 - 2 * (sr / sd)), 'up': ln(n)}}) AS e FROM {name}_s WHERE n >= 2 AND sr > 0 AND 2 * (sr / sd) < 1),
{name}_f AS (SELECT {k}skill_id, e, list_reduce(list_transform(e, lambda q: {{'c0': q.e0, 'c1': q.e1, 's0': '', 's1': '', 'up': q.up}}), lambda a, q: {{'c0': least(a.c0, a.c1) + q.c0, 'c1': least(a.c0 + q.up, a.c1) + q.c1,
  's0': (CASE WHEN a.c0 <= a.c1 THEN a.s0 ELSE a.s1 END) || '0', 's1': (CASE WHEN a.c0 + q.up <= a.c1 THEN a.s0 ELSE a.s1 END) || '1', 'up': q.up}}, {{'c0': 0.0::DOUBLE, 'c1': 'inf'::DOUBLE, 's0': '', 's1': '', 'up': 0.0::DOUBLE}}) AS z FROM {name}_e),
{name}_r AS (SELECT {k}skill_id, i, q, i - row_number() OVER (PARTITION BY {k}skill_id ORDER BY i) AS run FROM (SELECT {k}skill_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS q, CASE WHEN z.c0 <= z.c1 THEN z.s0 ELSE z.s1 END AS path FROM {name}_f) WHERE substr(path, i, 1) = '1'),
{name} AS (SELECT {k}skill_id, min(q.period) AS start_period, max(q.period) AS end_period, 1 AS level, sum(q.e0 - q.e1) AS weight FROM {name}_r GROUP BY {k}skill_id, run)"""


@query(f"{with_(RS, burst_sql('rs', 'role_id', 'b'))} SELECT * FROM b")
def burst_role(spark, d):
    return evolve.bursts(obs(spark, d, ["role_id"], sparse=True), ["role_id", "skill_id"])


@query(f"{with_(GS, burst_sql('gs', '', 'b'))} SELECT * FROM b")
def burst_global(spark, d):
    return evolve.bursts(obs(spark, d, [], sparse=True), ["skill_id"])


def trend_sql(source: str, name: str) -> str:
    return f"""{name}_x AS (SELECT skill_id, list(weight ORDER BY period) AS v FROM {source} GROUP BY 1 HAVING count(*) >= 4),
{name}_i AS (SELECT skill_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS v FROM {name}_x),
{name}_p AS (SELECT a.skill_id, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s, median((b.v - a.v) / (b.i - a.i)) AS slope FROM {name}_i a JOIN {name}_i b ON a.skill_id = b.skill_id AND b.i > a.i GROUP BY 1),
{name}_t AS (SELECT skill_id, CAST(sum(t) AS BIGINT) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT skill_id, v, count(*) AS t FROM {name}_i GROUP BY ALL) GROUP BY 1),
{name} AS (SELECT skill_id, n, s, CAST(n * (n - 1) * (2 * n + 5) - ties AS DOUBLE) / 18 AS var_s, CASE WHEN s = 0 THEN 0.0 ELSE (s - sign(s)) / sqrt(CAST(n * (n - 1) * (2 * n + 5) - ties AS DOUBLE) / 18) END AS z, slope FROM {name}_p JOIN {name}_t USING (skill_id))"""


@query(f"{with_(GD, trend_sql('gd', 't'))} SELECT * FROM t")
def trend_mk(spark, d):
    return evolve.mann_kendall(obs(spark, d, []), ["skill_id"])


@query(f"{with_(GS, trend_sql('gs', 't'), burst_sql('gs', '', 'b'))} SELECT skill_id, CASE WHEN z > 1.959964 THEN 'growth' WHEN z < -1.959964 THEN 'decline' WHEN skill_id IN (SELECT skill_id FROM b) THEN 'hype' ELSE 'stable' END AS trend FROM t")
def classify_skill(spark, d):
    o = obs(spark, d, [], sparse=True)
    return evolve.classify(evolve.mann_kendall(o, ["skill_id"]), evolve.bursts(o, ["skill_id"]), ["skill_id"])


@query(f"""{with_(SD)}, j AS (SELECT skill_id, period, a.weight AS x, b.weight AS y FROM (SELECT * FROM sd WHERE source_id = '{LEAD}') a JOIN (SELECT * FROM sd WHERE source_id = '{LAG}') b USING (skill_id, period)),
s AS (SELECT skill_id, count(*) OVER w AS n, row_number() OVER (PARTITION BY skill_id ORDER BY period) AS t, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy, stddev_pop(x) OVER w AS sx, stddev_pop(y) OVER w AS sy FROM j WINDOW w AS (PARTITION BY skill_id)),
c AS (SELECT a.skill_id, a.t - b.t AS k, a.n, round(sum(a.dx * b.dy) / (a.n * a.sx * a.sy), 9) AS correlation FROM s a JOIN s b ON a.skill_id = b.skill_id AND abs(a.t - b.t) <= least(8, a.n - 2) WHERE a.n >= 8 GROUP BY a.skill_id, a.t - b.t, a.n, a.sx, a.sy)
SELECT skill_id, CAST(-k AS BIGINT) AS lag_periods, correlation, n FROM (SELECT *, row_number() OVER (PARTITION BY skill_id ORDER BY correlation DESC, k) AS place FROM c) WHERE place = 1 AND correlation >= 1.96 / sqrt(n)""")
def lead_lag_ccf(spark, d):
    o = obs(spark, d, ["source_id"])
    return evolve.lead_lag(o.where(F.col("source_id") == LEAD), o.where(F.col("source_id") == LAG), ["skill_id"])


@query()
def lead_lag_granger(spark, d):
    o = obs(spark, d, ["source_id"])
    first, second = o.where(F.col("source_id") == LEAD), o.where(F.col("source_id") == LAG)
    lags = first.select("skill_id").distinct().join(evolve.lead_lag(first, second, ["skill_id"]), "skill_id", "left").select("skill_id", F.coalesce("lag_periods", F.lit(1)).alias("lag_periods"))
    return evolve.granger(first, second, ["skill_id"], lags)


@query(f"{with_(SD)} SELECT * FROM sd WHERE replace(lower(trim(source_id)), ' ', '_') NOT IN ('4-not_specified', '5-low')")
def leading_observations(spark, d):
    return evolve.not_leading(obs(spark, d, ["source_id"]), ["4-not_specified", "5-low"])


def loads(spark, d, by: list[str], chars=None) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("posting_id"), "l_quantity").groupBy("posting_id").agg(F.count("*").alias("mentions"), F.sum("l_quantity").alias("l_quantity"))
    n = F.coalesce(chars if chars is not None else F.col("l_quantity"), F.lit(0.0))
    return postings(spark, d).join(lines, "posting_id", "left").groupBy(*by).agg(F.count("*").alias("n_postings"), F.sum(F.coalesce("mentions", F.lit(0))).alias("n_skill_mentions"), F.round(F.sum(n), 6).cast("long").alias("total_text_chars"))


LOADS = "ln AS (SELECT l_orderkey AS posting_id, count(*) AS mentions, sum(l_quantity) AS chars FROM lineitem GROUP BY 1)"


def infl_sql(chars: str) -> str:
    """Loads, both series, their Mann-Kendall z, and points; density rises if z is beyond the 5 % point."""
    mk = lambda v, n: f"""{n}_p AS (SELECT CAST(sum(sign(b.{v} - a.{v})) AS BIGINT) AS s, median((b.{v} - a.{v}) / (b.i - a.i)) AS slope FROM il a JOIN il b ON b.i > a.i),
{n}_t AS (SELECT sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT count(*) AS t FROM il GROUP BY {v})),
{n} AS (SELECT CASE WHEN s = 0 THEN 0.0 ELSE (s - sign(s)) / sqrt(CAST(n * (n - 1) * (2 * n + 5) - ties AS DOUBLE) / 18) END AS z, slope FROM {n}_p, {n}_t)"""  # noqa: E731
    return f"""lo AS (SELECT period, count(*) AS n_postings, CAST(sum(coalesce(mentions, 0)) AS BIGINT) AS m, CAST(trunc(round(sum(coalesce({chars}, 0)), 6)) AS BIGINT) AS t FROM p LEFT JOIN ln USING (posting_id) GROUP BY 1),
il AS (SELECT period, n_postings, row_number() OVER (ORDER BY period) AS i, m / n_postings AS c_s, CASE WHEN t = 0 THEN 0.0 ELSE m / t END AS c FROM lo),
{mk("c", "zc")}, {mk("c_s", "zs")},
pt AS (SELECT period, c_s AS skills_per_posting, 1000 * c AS per_kchars, n_postings, CASE WHEN c > 0 AND (SELECT z FROM zc) > 1.959964 THEN (SELECT arg_min(c, period) FROM il WHERE c > 0) / c ELSE 1.0 END AS adjustment FROM il)"""


INFL, RISING = infl_sql("chars"), infl_sql("chars / (year(day) - 1990)")


def shrinking(spark, d, by: list[str]) -> DataFrame:
    """Loads whose texts get shorter from year to year, so that mentions are inflated."""
    return loads(spark, d, by, F.col("l_quantity") / (F.year("day") - 1990))


@query(f"{with_(LOADS, INFL)} SELECT * FROM pt")
def inflation_points(spark, d):
    return evolve.inflation(loads(spark, d, ["period"]))


@query(f"{with_(LOADS, RISING)} SELECT * FROM pt")
def inflation_points_rising(spark, d):
    return evolve.inflation(shrinking(spark, d, ["period"]))


@query(f"""{with_(LOADS, RISING)}, k AS (SELECT zs.z AS a, zc.z AS b, zc.slope AS density_slope FROM zs, zc)
SELECT CASE WHEN a > 1.959964 THEN 'increasing' WHEN a < -1.959964 THEN 'decreasing' ELSE 'no trend' END AS posting_trend, CASE WHEN b > 1.959964 THEN 'increasing' WHEN b < -1.959964 THEN 'decreasing' ELSE 'no trend' END AS density_trend, density_slope, b > 1.959964 AS inflated FROM k""")
def inflation_report(spark, d):
    """p-values are left out, as SQL has no normal distribution; the tests have them."""
    return evolve.inflation_report(shrinking(spark, d, ["period"])).drop("posting_p_value", "density_p_value")


@query(f"{with_(GD, LOADS, RISING)} SELECT skill_id, period, weight * coalesce(adjustment, 1.0) AS weight FROM gd LEFT JOIN pt USING (period)")
def inflation_deflated(spark, d):
    return evolve.deflate(obs(spark, d, []), evolve.inflation(shrinking(spark, d, ["period"]))).select("skill_id", "period", "weight")


@query(f"""{with_(LOADS)}, f AS (SELECT company, role_id, period, CAST(sum(coalesce(mentions, 0)) AS BIGINT) AS n_skills FROM p LEFT JOIN ln USING (posting_id) GROUP BY ALL)
SELECT company, role_id, avg(n_skills - market) AS deviation, count(*) AS n_periods FROM f JOIN (SELECT period, avg(n_skills) AS market FROM f GROUP BY 1) USING (period) GROUP BY ALL""")
def firm_effects(spark, d):
    return evolve.firm_effects(loads(spark, d, ["company", "role_id", "period"]).select("company", "role_id", "period", F.col("n_skill_mentions").alias("n_skills")))


def drift_sql(source: str) -> str:
    return f"""SELECT 'chg-' || role_id || '-' || skill_id || '-' || kind || '-{B}' AS change_id, role_id, skill_id, kind, before_weight, after_weight, '2001-04-01' AS occurred_on FROM (SELECT role_id, skill_id, a.weight AS before_weight, b.weight AS after_weight,
  CASE WHEN a.weight IS NULL THEN 'added' WHEN b.weight IS NULL THEN 'removed' WHEN abs(b.weight - a.weight) / a.weight >= 0.3 THEN 'modified' END AS kind
  FROM (SELECT * FROM {source} WHERE period = '{A}' AND weight >= 0.05) a FULL JOIN (SELECT * FROM {source} WHERE period = '{B}' AND weight >= 0.05) b USING (role_id, skill_id)) WHERE kind IS NOT NULL
  AND role_id IN (SELECT role_id FROM {source} WHERE period = '{A}') AND role_id IN (SELECT role_id FROM {source} WHERE period = '{B}')"""


def _drift(spark, d, sparse: bool) -> DataFrame:
    o = obs(spark, d, ["role_id"], sparse)
    return evolve.drift(o.where(F.col("period") == A), o.where(F.col("period") == B)).drop("reason")


@query(f"{with_(RD)} {drift_sql('rd')}")
def drift_dense(spark, d):
    return _drift(spark, d, False)


@query(f"{with_(RS)} {drift_sql('rs')}")
def drift_sparse(spark, d):
    return _drift(spark, d, True)


MEMBERS = "mb AS (SELECT DISTINCT p_type AS cluster_id, p_brand || '/' || p_type AS skill_id FROM part)"


def sparse_members(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_type").alias("cluster_id"), F.concat_ws("/", "p_brand", "p_type").alias("skill_id")).distinct()


def sourced_edges(spark, d) -> DataFrame:
    """source_id, period, a < b, weight: how many postings of a source mention both in a period."""
    m = mentions(spark, d, True)
    both = m.withColumnRenamed("skill_id", "a").join(m.withColumnRenamed("skill_id", "b"), "posting_id").where("a < b")
    return postings(spark, d).select("posting_id", "source_id", "period").join(both, "posting_id").groupBy("source_id", "period", "a", "b").agg(F.count("*").cast("double").alias("weight"))


CO = "co AS (SELECT source_id, period, x.skill_id AS a, y.skill_id AS b, CAST(count(*) AS DOUBLE) AS weight FROM p JOIN ms x USING (posting_id) JOIN ms y ON y.posting_id = p.posting_id AND x.skill_id < y.skill_id GROUP BY ALL)"


def density_sql(edges: str, name: str) -> str:
    return f"""{name}_k AS (SELECT a AS skill_id FROM {edges} UNION SELECT b FROM {edges}), {name}_m AS (SELECT * FROM mb WHERE skill_id IN (SELECT skill_id FROM {name}_k)),
{name}_n AS (SELECT cluster_id, count(*) AS n FROM {name}_m GROUP BY 1), {name}_w AS (SELECT x.cluster_id, sum(weight) AS w FROM {edges} JOIN {name}_m x ON a = x.skill_id JOIN {name}_m y ON b = y.skill_id AND x.cluster_id = y.cluster_id WHERE a <> b GROUP BY 1),
{name} AS (SELECT cluster_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CASE WHEN coalesce(n, 0) < 2 THEN 0.0 ELSE coalesce(w, 0) * 2.0 / (n * (n - 1)) END AS density FROM (SELECT DISTINCT cluster_id FROM mb) LEFT JOIN {name}_n USING (cluster_id) LEFT JOIN {name}_w USING (cluster_id))"""


@query(f"{with_(CO, MEMBERS)}, ce AS (SELECT a, b, sum(weight) AS weight FROM co GROUP BY ALL), {density_sql('ce', 'dn')} SELECT * FROM dn")
def cluster_density(spark, d):
    return evolve.cluster_density(sourced_edges(spark, d).groupBy("a", "b").agg(F.sum("weight").alias("weight")), sparse_members(spark, d))


CATALOGUE = "ca AS (SELECT 'o-' || p_type AS code, substr(p_type, 1, 6) AS name, list(DISTINCT p_brand || '/' || p_type) AS skill_ids FROM part WHERE p_type < 'LARGE' GROUP BY p_type)"


def catalogue(spark, d) -> DataFrame:
    """Some types as occupations, under names that hold part of a type."""
    p = table(spark, d, "part").where("p_type < 'LARGE'")
    return p.groupBy("p_type").agg(F.collect_set(F.concat_ws("/", "p_brand", "p_type")).alias("skill_ids")).select(F.concat(F.lit("o-"), "p_type").alias("code"), F.substring("p_type", 1, 6).alias("name"), "skill_ids")


GATES = f"""last4 AS (SELECT period FROM (SELECT DISTINCT period FROM co) ORDER BY period DESC LIMIT 4),
rec AS (SELECT * FROM co WHERE period IN (SELECT period FROM last4)), ear AS (SELECT * FROM co WHERE period NOT IN (SELECT period FROM last4)),
re AS (SELECT a, b, sum(weight) AS weight FROM rec GROUP BY ALL), ee AS (SELECT a, b, sum(weight) AS weight FROM ear GROUP BY ALL),
{density_sql('re', 'nw')}, {density_sql('ee', 'wa')},
cs AS (SELECT cluster_id, count(*) AS size FROM mb GROUP BY 1), cb AS (SELECT cluster_id, count(*) AS n_bursts FROM mb WHERE skill_id IN (SELECT skill_id FROM b) GROUP BY 1),
en AS (SELECT x.cluster_id, source_id, a, b FROM rec JOIN mb x ON a = x.skill_id JOIN mb y ON b = y.skill_id AND x.cluster_id = y.cluster_id),
tc AS (SELECT cluster_id, source_id, count(DISTINCT skill_id) AS covered FROM (SELECT source_id, a AS skill_id FROM rec UNION ALL SELECT source_id, b FROM rec) JOIN mb USING (skill_id) GROUP BY ALL),
so AS (SELECT cluster_id, count(*) AS n_sources FROM tc JOIN cs USING (cluster_id) WHERE covered >= greatest(2, floor(0.5 * size + 0.999)) AND (cluster_id, source_id) IN (SELECT (cluster_id, source_id) FROM en) GROUP BY 1),
li AS (SELECT cluster_id, count(DISTINCT (a, b)) AS n_links FROM en WHERE a <> b GROUP BY 1),
ro AS (SELECT DISTINCT role_id, skill_id FROM rs WHERE period = '{B}' AND weight >= 0.05), rz AS (SELECT role_id, count(*) AS role_size FROM ro GROUP BY 1),
nd AS (SELECT cluster_id, min(1 - common / (role_size + size - common)) AS d FROM (SELECT cluster_id, role_id, count(*) AS common FROM mb JOIN ro USING (skill_id) GROUP BY ALL) JOIN rz USING (role_id) JOIN cs USING (cluster_id) GROUP BY 1),
cl AS (SELECT cluster_id, list(skill_id) AS skills FROM mb GROUP BY 1),
ch AS (SELECT cluster_id, min(code) AS catalogue_code FROM cl, ca WHERE 1 - len(list_intersect(skills, skill_ids)) / len(list_distinct(list_concat(skills, skill_ids))) < 0.4
  OR contains(replace(lower(cluster_id), ' ', ''), replace(lower(name), ' ', '')) OR contains(replace(lower(name), ' ', ''), replace(lower(cluster_id), ' ', '')) GROUP BY 1),
g AS (SELECT cluster_id, size, CASE WHEN wa.density > 0 THEN nw.density / wa.density WHEN nw.density > 0 THEN 99.0 ELSE 0.0 END AS density_ratio, coalesce(n_bursts, 0) AS n_bursts, coalesce(n_sources, 0) AS n_sources, coalesce(d, 1.0) AS min_distance, catalogue_code, coalesce(n_links, 0) AS n_links
  FROM nw JOIN wa USING (cluster_id) JOIN cs USING (cluster_id) LEFT JOIN cb USING (cluster_id) LEFT JOIN so USING (cluster_id) LEFT JOIN nd USING (cluster_id) LEFT JOIN ch USING (cluster_id) LEFT JOIN li USING (cluster_id)),
gs2 AS (SELECT *, CASE WHEN density_ratio < 2 THEN 'not_new' WHEN n_bursts < 2 THEN 'few_bursts' WHEN n_sources < 2 THEN 'one_source' WHEN min_distance < 0.4 THEN 'near_role' WHEN catalogue_code IS NOT NULL THEN 'in_catalogue' END AS failed_gate,
  (n_bursts / size + least(n_sources / 3, 1.0) + least(min_distance / 0.8, 1.0) + CASE WHEN density_ratio >= 99 THEN 1.0 WHEN density_ratio <= 1 THEN 0.0 ELSE least(log2(density_ratio) / 2, 1.0) END) / 4 AS strength FROM g)"""


def emerging_inputs(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, skills with bursts, and roles' skills."""
    roles = obs(spark, d, ["role_id"], sparse=True).where((F.col("period") == B) & (F.col("weight") >= 0.05)).select("role_id", "skill_id")
    return sourced_edges(spark, d), evolve.bursts(obs(spark, d, [], sparse=True), ["skill_id"]).select("skill_id"), roles


def _gates(spark, d) -> DataFrame:
    e, bursts, roles = emerging_inputs(spark, d)
    members = sparse_members(spark, d)
    names = members.select("cluster_id", F.col("cluster_id").alias("name")).distinct()
    return evolve.emerging_gates(members, evolve.recent_edges(e), bursts, roles, catalogue(spark, d), names)


@query(f"{with_(RS, GS, burst_sql('gs', '', 'b'), CO, MEMBERS, CATALOGUE, GATES)} SELECT cluster_id, size, density_ratio, n_bursts, n_sources, min_distance, catalogue_code, failed_gate FROM gs2")
def emerging_gates(spark, d):
    return _gates(spark, d).drop("strength", "zone", "evidence_count")


@query(f"{with_(RS, GS, burst_sql('gs', '', 'b'), CO, MEMBERS, CATALOGUE, GATES)} SELECT cluster_id, strength, CASE WHEN strength >= 0.65 THEN 'publish' ELSE 'watch' END AS zone, n_sources + n_bursts + n_links AS evidence_count FROM gs2")
def emerging_strength(spark, d):
    return _gates(spark, d).select("cluster_id", "strength", "zone", "evidence_count")


@query()
def discover_emerging(spark, d):
    e, bursts, roles = emerging_inputs(spark, d)
    return evolve.discover_emerging(e, bursts, roles, catalogue(spark, d), "0.1")


@query()
def louvain_clusters(spark, d):
    return evolve.louvain(graph.pair_counts(edges(spark, d)).select("a", "b", F.col("both").cast("double").alias("weight")))


MOVES = f"""mv AS (SELECT skill_id, a.weight - coalesce(b.weight, 0) AS raw FROM (SELECT * FROM gs WHERE period = '{B}') a LEFT JOIN (SELECT * FROM gs WHERE period = '{A}') b USING (skill_id)),
mw AS (SELECT skill_id, round(raw, 4) AS delta, CASE WHEN raw > 0.005 THEN 'rise' ELSE 'fall' END AS direction FROM mv WHERE raw > 0.005 OR raw < -0.005)"""


@query(f"{with_(GS, MOVES)} SELECT skill_id, delta, direction, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY direction ORDER BY abs(delta) DESC, skill_id) AS INT) AS place FROM mw) WHERE place <= 8")
def market_moves(spark, d):
    return observe.market_moves(obs(spark, d, [], sparse=True), B, A, 0.005)


@query(f"{with_(GD)} SELECT skill_id, sum(weight) AS total_weight FROM gd GROUP BY 1 ORDER BY round(sum(weight), 9) DESC, 1 LIMIT 12")
def trend_top12(spark, d):
    return observe.top_skills(obs(spark, d, []))


PIVOT = ["2000Q3", "2000Q4", "2001Q1", "2001Q2"]


@query(f"{with_(GD)} SELECT skill_id, " + ", ".join(f"coalesce(round(100 * max(weight) FILTER (period = '{p}'), 1), 0.0) AS \"{p}\"" for p in PIVOT) + f" FROM gd WHERE period IN ({', '.join(map(repr, PIVOT))}) GROUP BY 1")
def trend_pivot(spark, d):
    return observe.pivot_series(obs(spark, d, []), PIVOT)


@query(f"""{with_(GS, burst_sql('gs', '', 'b'))} SELECT skill_id, q.period, level, weight FROM b JOIN (SELECT DISTINCT period FROM p) q ON q.period BETWEEN start_period AND end_period""")
def burst_heatmap(spark, d):
    first = lambda c: F.make_date(F.substring(c, 1, 4).cast("int"), F.substring(c, 6, 1).cast("int") * 3 - 2, F.lit(1))
    return burst_global(spark, d).select("skill_id", F.explode(F.sequence(first("start_period"), first("end_period"), F.expr("interval 3 months"))).alias("day"), "level", "weight").select("skill_id", period_of(F.col("day")).alias("period"), "level", "weight")


@query(f"{with_(RD, TYPES)} SELECT role_id, skill_id, a.weight AS before_weight, b.weight AS after_weight, round(coalesce(b.weight, 0) - coalesce(a.weight, 0), 6) AS delta, competency FROM (SELECT * FROM rd WHERE period = '{A}') a FULL JOIN (SELECT * FROM rd WHERE period = '{B}') b USING (role_id, skill_id) LEFT JOIN types USING (skill_id)")
def role_evolution(spark, d):
    """Which skills matter for each role in a slice, and what changed since the one before."""
    o = obs(spark, d, ["role_id"])
    side = lambda p, name: graph.slice_of(o, p).select("role_id", "skill_id", F.col("weight").alias(name))
    j = side(A, "before_weight").join(side(B, "after_weight"), ["role_id", "skill_id"], "full_outer").join(types(spark, d), "skill_id", "left")
    return j.select("role_id", "skill_id", "before_weight", "after_weight", F.round(F.coalesce("after_weight", F.lit(0.0)) - F.coalesce("before_weight", F.lit(0.0)), 6).alias("delta"), "competency")
