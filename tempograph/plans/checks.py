"""Queries on planted structures and on operators that other queries use in part only; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate, evolve, graph, pages, review
from ..sources.tables import table
from .evolution import A, B, LAG, LEAD, RD, ROLE, RS, SD, TYPES, burst_sql, obs, types, with_
from .evolution import SQL as EVOLUTION_SQL
from .operations import ROLES, roles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Planted clusters: every six parts that follow each other are skills that come together


def planted_skills(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.format_string("s%08d", "p_partkey").alias("skill_id"), F.floor(F.col("p_partkey") / 6).alias("of"))


def planted_edges(spark, d) -> DataFrame:
    """source_id, period, a, b, weight: three sources tell all pairs of a cluster late, and weakly one of them early."""
    s = planted_skills(spark, d)
    both = s.withColumnRenamed("skill_id", "a").join(s.withColumnRenamed("skill_id", "b"), "of").where("a < b").select("a", "b")
    told = [F.struct(F.lit(f"src{k}").alias("source_id"), F.lit(f"2024Q{q}").alias("period"), F.lit(5.0).alias("weight")) for k in range(3) for q in (1, 4)] + [F.struct(F.lit("src0").alias("source_id"), F.lit("2022Q1").alias("period"), F.lit(1.0).alias("weight"))]
    early = [F.struct(F.lit("src9").alias("source_id"), F.lit(f"2023Q{q}").alias("period"), F.lit(0.0).alias("weight")) for q in (1, 2, 3, 4)]
    return both.select("a", "b", F.explode(F.array(*told, *early)).alias("t")).select("t.source_id", "t.period", "a", "b", "t.weight")


_PLANTED = """s AS (SELECT printf('s%08d', p_partkey) AS skill_id, p_partkey // 6 AS c FROM part), k AS (SELECT c, count(*) AS n, string_agg(skill_id, ',' ORDER BY skill_id) AS ids, array_to_string(list_sort(list(skill_id))[1:3], '-') AS name FROM s GROUP BY c)"""


@query(f"WITH {_PLANTED} SELECT 'cand-' || substr(md5('0.1:' || ids), 1, 12) AS role_id, name, ids AS skill_ids, 'publish' AS zone, 'held' AS state, 1.0::DOUBLE AS strength, CAST(4 + n + n * (n - 1) // 2 AS BIGINT) AS evidence_count FROM k WHERE n >= 3")
def discover_planted(spark, d):
    """Emerging roles where they have been planted: dense of late, bursting, told by four sources (one of them without weight), like no
    role and in no catalogue."""
    s = planted_skills(spark, d)
    roles = spark.createDataFrame([("other", "x")], "role_id string, skill_id string")
    catalogue = spark.createDataFrame([("1", "unlike any", ["x", "y"])], "code string, name string, skill_ids array<string>")
    found = evolve.discover_emerging(planted_edges(spark, d), s.select("skill_id"), roles, catalogue, "0.1")
    return found.withColumn("skill_ids", F.array_join("skill_ids", ","))


@query(f"WITH {_PLANTED} SELECT 'cluster-' || (row_number() OVER (ORDER BY n DESC, name) - 1) AS cluster_id, unnest(string_split(ids, ',')) AS skill_id FROM k WHERE n >= 2")
def communities_by_rounds(spark, d):
    """The planted clusters by rounds of joins, the way of graphs that no task holds."""
    return evolve.communities(planted_edges(spark, d))


# Versions of the ontology


@query(f"""{with_(RD)}, v AS (SELECT *, CASE WHEN role_id < 'C' AND period = '{B}' THEN '2' ELSE '1' END AS version FROM rd WHERE period IN ('{A}', '{B}')),
r AS (SELECT role_id FROM v GROUP BY 1 HAVING count(DISTINCT version) = 1), a AS (SELECT role_id, skill_id, weight AS w0 FROM v WHERE period = '{A}'), b AS (SELECT role_id, skill_id, weight AS w1 FROM v WHERE period = '{B}'),
j AS (SELECT role_id, skill_id, coalesce(w0, 0) AS w0, coalesce(w1, 0) AS w1 FROM a FULL JOIN b USING (role_id, skill_id) WHERE role_id IN (SELECT role_id FROM r) AND role_id IN (SELECT role_id FROM a) AND role_id IN (SELECT role_id FROM b)),
k AS (SELECT *, CASE WHEN w0 < 0.05 AND w1 >= 0.05 THEN 'added' WHEN w0 >= 0.05 AND w1 < 0.05 THEN 'removed' WHEN w0 >= 0.05 AND w1 >= 0.05 AND abs(w1 - w0) / greatest(abs(w0), 1e-9) >= 0.3 THEN 'modified' END AS kind FROM j)
SELECT role_id, skill_id, kind, '技能点 ' || skill_id || CASE kind WHEN 'added' THEN ' 在 {B} 首次达到显著重要度 （' || format('{{:.2f}}', round_even(w1, 2)) || '），上一时间片不存在或低于噪声地板 0.05' WHEN 'removed' THEN ' 在 {B} 从岗位能力要求中消失（此前重要度 ' || format('{{:.2f}}', round_even(w0, 2)) || '）'
  ELSE ' 重要度由 ' || format('{{:.2f}}', round_even(w0, 2)) || ' 变为 ' || format('{{:.2f}}', round_even(w1, 2)) || '（相对变化 ' || CAST(round_even(abs(w1 - w0) / greatest(abs(w0), 1e-9) * 100, 0) AS BIGINT) || '%）' END AS reason FROM k WHERE kind IS NOT NULL""")
def drift_of_one_version(spark, d):
    """Changes with their reasons; roles of the first letters have changed to another version and are left out."""
    o = obs(spark, d, ["role_id"]).withColumn("ontology_version", F.when((F.col("role_id") < "C") & (F.col("period") == B), "2").otherwise("1"))
    return evolve.drift(o.where(F.col("period") == A), o.where(F.col("period") == B)).select("role_id", "skill_id", "kind", "reason")


@query(f"""{with_(SD)}, v AS (SELECT *, CASE WHEN period >= '1997Q1' AND length(skill_id) % 2 = 0 THEN '2' ELSE '1' END AS version FROM sd), j AS (SELECT skill_id, period, version, a.weight AS x, b.weight AS y FROM (SELECT * FROM v WHERE source_id = '{LEAD}') a JOIN (SELECT * FROM v WHERE source_id = '{LAG}') b USING (skill_id, period, version)),
l AS (SELECT skill_id, arg_max(version, (period, version)) AS version FROM j GROUP BY 1) SELECT skill_id, period, x, y FROM j JOIN l USING (skill_id, version)""")
def aligned_series(spark, d):
    """Pairs of weights of two sources, of the version of the last period that both have."""
    o = obs(spark, d, ["source_id"]).withColumn("ontology_version", F.when((F.col("period") >= "1997Q1") & (F.length("skill_id") % 2 == 0), "2").otherwise("1"))
    return evolve.aligned(o.where(F.col("source_id") == LEAD), o.where(F.col("source_id") == LAG), ["skill_id"])


# Pages and reviews


@query(f"{with_(RD)} SELECT skill_id, period, weight FROM rd WHERE role_id = '{ROLE}' AND period = '{B}'")
def role_detail_skills(spark, d):
    return pages.role_detail(obs(spark, d, ["role_id"]), types(spark, d), ROLE, B, A)[0].select("skill_id", "period", "weight")


@query(f"""{with_(RD, TYPES)}, m AS (SELECT coalesce(competency, 'skill:' || skill_id) AS competency, period, list_sort(list((skill_id, round(weight, 6)))) AS w FROM rd LEFT JOIN types USING (skill_id) WHERE role_id = '{ROLE}' AND period IN ('{A}', '{B}') GROUP BY ALL)
SELECT competency, CASE WHEN a.w IS NULL THEN 'added' WHEN b.w IS NULL THEN 'removed' ELSE 'modified' END AS kind FROM (SELECT * FROM m WHERE period = '{A}') a FULL JOIN (SELECT * FROM m WHERE period = '{B}') b USING (competency) WHERE a.w IS DISTINCT FROM b.w""")
def role_detail_changes(spark, d):
    return pages.role_detail(obs(spark, d, ["role_id"]), types(spark, d), ROLE, B, A)[1].select("competency", "kind")


@query(f"""{with_(RD)}, e AS (SELECT DISTINCT role_id, skill_id FROM rd), n AS (SELECT node_id, kind FROM (SELECT role_id AS node_id, 'role' AS kind FROM e UNION SELECT skill_id, 'skill' FROM e) ORDER BY kind, node_id LIMIT 12)
SELECT role_id, skill_id FROM e WHERE role_id IN (SELECT node_id FROM n WHERE kind = 'role') AND skill_id IN (SELECT node_id FROM n WHERE kind = 'skill')""")
def capped_graph(spark, d):
    """The edges among the first twelve nodes."""
    edges = obs(spark, d, ["role_id"]).select("role_id", "skill_id").distinct()
    return graph.capped(edges, 12)[1]


@query("""WITH s AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN 'bad.' ELSE 'skill.' END || CASE WHEN p_partkey % 40 = 39 THEN p_partkey - 1 ELSE p_partkey END AS id, p_partkey AS k FROM part),
p AS (SELECT id, k, CASE WHEN k % 30 = 1 THEN 'skill.none' WHEN k % 30 = 2 THEN id WHEN k % 30 = 3 THEN 'skill.' || (k + 1) WHEN k % 30 = 4 THEN 'skill.' || (k - 1) END AS parent_id, k % 25 = 7 AS bare, k % 35 = 5 AS lost FROM s),
a AS (SELECT 'A' || k // 2 AS surface, id AS skill_id, k FROM s WHERE k % 7 < 3 UNION ALL SELECT 'z' || k, 'skill.gone', k FROM s WHERE k % 60 = 0),
i AS (SELECT DISTINCT id FROM s), x AS (SELECT DISTINCT id, parent_id FROM p WHERE parent_id IN (SELECT id FROM i) AND parent_id <> id)
SELECT 'few_skills' AS "check", CASE WHEN count(*) < 600 THEN 1 ELSE 0 END AS n FROM s UNION ALL SELECT 'few_aliases', CASE WHEN (SELECT count(*) FROM a) < 2 * count(*) THEN 1 ELSE 0 END FROM s
UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT id FROM s GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'malformed_id', count(*) FROM s WHERE id NOT LIKE 'skill.%' UNION ALL SELECT 'no_alias', count(*) FROM p WHERE bare UNION ALL SELECT 'unknown_cluster', count(*) FROM p WHERE lost
UNION ALL SELECT 'unknown_parent', count(*) FROM p WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM i) UNION ALL SELECT 'own_parent', count(*) FROM p WHERE parent_id = id UNION ALL SELECT 'unknown_target', count(*) FROM a WHERE skill_id NOT IN (SELECT id FROM i)
UNION ALL SELECT 'alias_conflict', count(*) FROM (SELECT lower(surface) FROM a GROUP BY 1 HAVING count(DISTINCT skill_id) > 1) UNION ALL SELECT 'parent_cycle', count(DISTINCT u.id) FROM x u JOIN x v ON u.parent_id = v.id AND v.parent_id = u.id""")
def ontology_report(spark, d):
    """All checks of a vocabulary, made of parts with faults of every kind."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    s = table(spark, d, "part").select(k.alias("k"), F.concat(F.when(k % 50 == 0, "bad.").otherwise("skill."), text(F.when(k % 40 == 39, k - 1).otherwise(k))).alias("id"))
    k = F.col("k")
    parent = F.when(k % 30 == 1, "skill.none").when(k % 30 == 2, F.col("id")).when(k % 30 == 3, F.concat(F.lit("skill."), text(k + 1))).when(k % 30 == 4, F.concat(F.lit("skill."), text(k - 1)))
    names = F.when(k % 25 == 7, F.array().cast("array<string>")).otherwise(F.array("id"))
    skills = s.select("id", parent.alias("parent_id"), F.when(k % 35 == 5, "lost").otherwise("c").alias("cluster_id"), names.alias("aliases"))
    aliases = s.where(k % 7 < 3).select(F.concat(F.lit("A"), text(F.floor(k / 2))).alias("surface"), F.col("id").alias("skill_id"))
    aliases = aliases.unionByName(s.where(k % 60 == 0).select(F.concat(F.lit("z"), text(k)).alias("surface"), F.lit("skill.gone").alias("skill_id")))
    return evaluate.ontology_errors(skills, aliases, spark.createDataFrame([("c",)], "cluster_id string"))


@query("""WITH d AS (SELECT doc_id, text, doc_id % 3 AS k FROM documents WHERE text IS NOT NULL AND length(text) >= 10)
SELECT doc_id, k <> 1 AS span_ok, doc_id % 5 <> 0 AS box_ok, k <> 2 OR lower(substr(text, 4, 6)) = lower(substr(text, 3, 6)) AS quote_ok, k <> 1 AND doc_id % 5 <> 0 AND (k <> 2 OR lower(substr(text, 4, 6)) = lower(substr(text, 3, 6))) AS traced FROM d""")
def traced_names(spark, d):
    """Predicted names with other spans, boxes elsewhere and quotes from another place."""
    t = table(spark, d, "documents").where("text is not null and length(text) >= 10").withColumn("k", F.col("doc_id") % 3)
    box = lambda x: F.array(F.lit(x), F.lit(0.0), F.lit(x) + 10.0, F.lit(10.0))
    gold = t.select("doc_id", F.lit("n").alias("name"), F.when(F.col("k") == 1, 4).otherwise(3).alias("start"), F.lit(9).alias("end"), box(0.0).alias("box"))
    said = F.when(F.col("k") == 2, F.substring("text", 3, 6)).otherwise(F.substring("text", 4, 6))
    pred = t.select("doc_id", F.lit("n").alias("name"), F.lit(3).alias("start"), F.lit(9).alias("end"), said.alias("surface"), F.when(F.col("doc_id") % 5 == 0, box(8.0)).otherwise(box(1.0)).alias("box"))
    return review.trace_flags(pred, gold, t).drop("name")


@query("""SELECT -doc_id AS place, 'ev.' || doc_id AS evidence_id, source AS source_id, CASE WHEN doc_id % 2 = 0 THEN 'x' END AS skill_id, CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 9 = 0 THEN 'posting' ELSE 'resume' END AS kind, CASE WHEN doc_id % 9 = 0 THEN 'q' ELSE sha256(text) END AS text_sha256,
  CASE WHEN doc_id % 9 = 0 THEN 1 ELSE CAST(least(80, len(string_split(text, chr(10)))) AS BIGINT) END AS n_lines FROM documents WHERE doc_id % 3 = 0""")
def evidence_pages(spark, d):
    """Evidence in the order of asking, with its document; that of every ninth text is gone, so its quote is shown."""
    t = table(spark, d, "documents")
    asked = t.where("doc_id % 3 = 0").select(F.concat(F.lit("ev."), F.col("doc_id").cast("string")).alias("evidence_id"), (-F.col("doc_id")).alias("place"))
    missing = spark.createDataFrame([("ev.none", 0)], "evidence_id string, place long")
    evidence = t.select(F.concat(F.lit("ev."), F.col("doc_id").cast("string")).alias("evidence_id"), F.col("source").alias("source_id"), "doc_id", F.lit("q").alias("quote"), F.when(F.col("doc_id") % 2 == 0, "ac:x").otherwise("model").alias("extractor"))
    found = review.evidence_details(asked.unionByName(missing), evidence, t.where("doc_id % 9 <> 0").select("doc_id", F.lit("resume").alias("kind"), "text"))
    text = F.when(F.col("text") == "q", F.col("text")).otherwise(F.sha2("text", 256))
    return found.select("place", "evidence_id", "source_id", "skill_id", "doc_id", "kind", text.alias("text_sha256"), F.size("lines").cast("long").alias("n_lines"))


# The parts of the market's page


def _market(spark, d, part: str, sparse: bool = False) -> DataFrame:
    covers = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("skill_id"), F.col("p_type").alias("competency")).distinct()
    return pages.market(obs(spark, d, ["role_id"], sparse), roles(spark, d), covers, B, A)[part]


@query(f"WITH {ROLES} SELECT role_id FROM ro WHERE is_emerging")
def market_emerging(spark, d):
    return _market(spark, d, "emerging").select("role_id")


@query(f"WITH {ROLES} SELECT role_id, CASE WHEN signal_strength >= 0.65 THEN 'strong' WHEN signal_strength >= 0.4 THEN 'medium' ELSE 'weak' END AS signal_band FROM ro WHERE state = 'unverified'")
def market_candidates(spark, d):
    return _market(spark, d, "candidates").select("role_id", "signal_band")


@query(EVOLUTION_SQL["competency_diff"])
def market_changes(spark, d):
    return _market(spark, d, "changes", sparse=True)


@query(f"{with_(RS, 'ps AS (SELECT skill_id, period, sum(posting_count) AS posting_count, sum(total_postings) AS total_postings FROM rs GROUP BY ALL)', burst_sql('ps', '', 'b'))} SELECT * FROM b ORDER BY skill_id, start_period LIMIT 40")
def market_bursts(spark, d):
    return _market(spark, d, "bursts", sparse=True)


@query(f"{with_(RD)} SELECT role_id, skill_id, weight FROM rd WHERE period = '{B}'")
def market_observations(spark, d):
    return _market(spark, d, "observations").select("role_id", "skill_id", "weight")
