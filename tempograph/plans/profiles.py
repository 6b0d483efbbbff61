"""Queries on matching, text, evaluation, review and streams, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import evaluate, evolve, graph, ingest, match, vectors
from ..sources.shared import kept
from ..sources.tables import mentions, postings, table
from ..streaming import arrivals
from .evolution import B, GD, RD, burst_sql, obs, with_

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PROFILES = "pf AS (SELECT company AS profile_id, skill_id, CAST(least(3, count(*)) AS INT) AS level FROM p JOIN md USING (posting_id) GROUP BY ALL)"
SPECS = f"sc AS (SELECT role_id, skill_id, CASE WHEN weight >= 0.14 THEN 'required' ELSE 'bonus' END AS necessity, weight AS importance, CASE WHEN weight >= 0.17 THEN 3 WHEN weight >= 0.15 THEN 2 WHEN weight >= 0.1 THEN 1 ELSE 0 END AS required_level FROM rd WHERE period = '{B}')"
JUDGED = """jd AS (SELECT profile_id, role_id, sc.skill_id, necessity, importance, required_level, coalesce(level, 0) AS held_level, level IS NOT NULL AS present, CASE WHEN coalesce(level, 0) >= required_level THEN 'satisfied' WHEN level IS NULL THEN 'missing' ELSE 'insufficient' END AS verdict
  FROM (SELECT DISTINCT profile_id FROM pf) CROSS JOIN sc LEFT JOIN pf USING (profile_id, skill_id))"""
METRICS = """jc AS (SELECT *, necessity = 'required' AND row_number() OVER (PARTITION BY profile_id, role_id ORDER BY necessity DESC, importance DESC, skill_id) <= 3 AS critical FROM jd),
mt AS (SELECT profile_id, role_id, coalesce(avg((verdict = 'satisfied')::INT) FILTER (necessity = 'required'), 1.0) AS required_coverage, coalesce(avg((verdict = 'satisfied')::INT) FILTER (necessity <> 'required'), 1.0) AS bonus_coverage,
  coalesce(sum(importance * (verdict = 'satisfied')::INT) FILTER (necessity = 'required') / sum(importance) FILTER (necessity = 'required'), 1.0) AS weighted_coverage,
  coalesce(sum(importance * CASE WHEN required_level = 0 THEN 1.0 ELSE least(held_level / required_level, 1.0) END) FILTER (necessity = 'required') / sum(importance) FILTER (necessity = 'required'), 1.0) AS partial,
  CAST(sum(critical::INT) AS BIGINT) AS n_critical, CAST(sum((critical AND held_level = 0)::INT) AS BIGINT) AS critical_missing FROM jc GROUP BY ALL)"""
TIERS = """ti AS (SELECT profile_id, role_id, CASE WHEN required_coverage >= 0.85 AND weighted_coverage >= 0.8 AND critical_missing <= 0 THEN 'strong' WHEN required_coverage >= 0.6 AND weighted_coverage >= 0.5 AND critical_missing <= 1 THEN 'adequate'
  WHEN required_coverage >= 0.3 OR weighted_coverage >= 0.3 THEN 'gapped' ELSE 'mismatch' END AS tier, 0.5 * required_coverage + 0.4 * partial + 0.1 * (1 - critical_missing / greatest(n_critical, 1)) AS score FROM mt)"""
GAPS = """bw AS (SELECT skill_id, max(weight) AS burst FROM b GROUP BY 1),
gp AS (SELECT profile_id, role_id, skill_id, CASE WHEN present THEN 'insufficient' ELSE 'missing' END AS kind, greatest(0.0, importance * (CASE WHEN NOT present THEN 1.0 ELSE (required_level - held_level) / required_level END) * (1 + greatest(coalesce(burst, 0.0), 0.0))) AS urgency
  FROM jd LEFT JOIN bw USING (skill_id) WHERE NOT present OR held_level < required_level)"""
SURPLUS = "su AS (SELECT profile_id, role_id, skill_id, level AS held_level FROM pf CROSS JOIN (SELECT DISTINCT role_id FROM sc) WHERE (role_id, skill_id) NOT IN (SELECT (role_id, skill_id) FROM sc))"


def profiles(spark, d) -> DataFrame:
    return postings(spark, d).join(mentions(spark, d), "posting_id").groupBy(F.col("company").alias("profile_id"), "skill_id").agg(F.least(F.lit(3), F.count("*")).cast("int").alias("level"))


def specs(spark, d) -> DataFrame:
    w = F.col("weight")
    level = F.when(w >= 0.17, 3).when(w >= 0.15, 2).when(w >= 0.1, 1).otherwise(0)
    return graph.slice_of(obs(spark, d, ["role_id"]), B).select("role_id", "skill_id", F.when(w >= 0.14, "required").otherwise("bonus").alias("necessity"), w.alias("importance"), level.alias("required_level"))


def some_specs(spark, d) -> DataFrame:
    """Specs of a role without every fifth skill, so that profiles hold some that it doesn't ask for."""
    return specs(spark, d).where("ascii(role_id) % 5 <> cast(substring(skill_id, 7) as int) % 5")


SOME = "sc AS (SELECT * FROM sc0 WHERE ascii(role_id) % 5 <> CAST(substr(skill_id, 7) AS INT) % 5)"
SOME_SPECS = SPECS.replace("sc AS", "sc0 AS") + ", " + SOME


def burst_weights(spark, d) -> DataFrame:
    return evolve.bursts(obs(spark, d, ["role_id"]), ["role_id", "skill_id"]).groupBy("skill_id").agg(F.max("weight").alias("burst"))


@query(f"{with_(PROFILES)} SELECT * FROM pf")
def profile_levels(spark, d):
    return match.profile_levels(profiles(spark, d))


@query(f"{with_(RD, SPECS)} SELECT * FROM sc")
def merge_specs(spark, d):
    s = specs(spark, d)
    return match.merge_specs(s.union(s.withColumn("necessity", F.lit("bonus"))))


@query(f"{with_(RD, PROFILES, SPECS, JUDGED)} SELECT * FROM jd")
def judge_skills(spark, d):
    return match.judge(profiles(spark, d), specs(spark, d))


@query(f"{with_(RD, PROFILES, SPECS, JUDGED, METRICS)} SELECT * FROM mt")
def match_metrics(spark, d):
    return match.metrics(profiles(spark, d), specs(spark, d))


@query(f"{with_(RD, PROFILES, SPECS, JUDGED, METRICS, TIERS)} SELECT * FROM ti")
def match_tier(spark, d):
    return match.tier(match_metrics(spark, d))


@query(f"{with_(RD, burst_sql('rd', 'role_id', 'b'), PROFILES, SPECS, JUDGED, GAPS)} SELECT * FROM gp")
def gap_urgency(spark, d):
    return match.gaps(judge_skills(spark, d), burst_weights(spark, d))


@query(f"{with_(RD, PROFILES, SOME_SPECS, SURPLUS)} SELECT * FROM su")
def surplus_skills(spark, d):
    return match.surplus(profiles(spark, d), some_specs(spark, d))


@query(f"{with_(RD, PROFILES, SPECS, JUDGED, METRICS, TIERS)} SELECT profile_id, role_id, tier, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 9) DESC, role_id) AS INT) AS place FROM ti) WHERE place <= 3")
def recommend_roles(spark, d):
    return match.recommend(match_tier(spark, d))


def _percent(c: str) -> str:
    return f"CAST(CAST(round_even({c} * 100, 0) AS BIGINT) AS VARCHAR) || '%'"


@query(f"""{with_(RD, burst_sql('rd', 'role_id', 'b'), PROFILES, SOME_SPECS, JUDGED, METRICS, TIERS, GAPS, SURPLUS)}, n AS (SELECT profile_id, role_id, count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'insufficient') AS n_insufficient FROM gp GROUP BY ALL),
ns AS (SELECT profile_id, role_id, count(*) AS n_surplus FROM su GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(score, 9) DESC, role_id) AS place FROM ti),
ot AS (SELECT profile_id, role_id, list(o ORDER BY place)[1:3] AS others FROM (SELECT a.profile_id, a.role_id, b.role_id AS o, b.place FROM ti a JOIN rk b ON a.profile_id = b.profile_id AND a.role_id <> b.role_id) GROUP BY ALL)
SELECT profile_id, role_id, tier, score, weighted_coverage AS coverage, coalesce(n_missing, 0) AS n_missing, coalesce(n_insufficient, 0) AS n_insufficient, coalesce(n_surplus, 0) AS n_surplus,
  '判定为「' || CASE tier WHEN 'strong' THEN '高度匹配' WHEN 'adequate' THEN '基本匹配' WHEN 'gapped' THEN '有明显差距' ELSE '不匹配' END || '」。必备技能覆盖率 ' || {_percent('required_coverage')} || '，加权覆盖率 ' || {_percent('weighted_coverage')} || '。'
  || CASE WHEN critical_missing > 0 THEN '关键技能缺失 ' || critical_missing || ' 项。' ELSE '' END || CASE WHEN n_missing > 0 THEN '完全缺失 ' || n_missing || ' 项。' ELSE '' END || CASE WHEN n_insufficient > 0 THEN '水平不足 ' || n_insufficient || ' 项。' ELSE '' END AS rationale,
  CASE WHEN n_surplus > 0 THEN array_to_string(others, ',') ELSE '' END AS better_fit
FROM mt JOIN ti USING (profile_id, role_id) LEFT JOIN n USING (profile_id, role_id) LEFT JOIN ns USING (profile_id, role_id) LEFT JOIN ot USING (profile_id, role_id)""")
def diagnose_profiles(spark, d):
    return match.diagnose(profiles(spark, d), some_specs(spark, d)).withColumn("better_fit", F.array_join("better_fit", ","))


CHAIN = "SELECT DISTINCT 'Brand#' || (CAST(substr(p_brand, 7) AS INT) + 1) AS dst, p_brand AS src FROM part WHERE CAST(substr(p_brand, 7) AS INT) % 5 <> 0"


def chain(spark, d) -> DataFrame:
    n = F.substring("p_brand", 7, 9).cast("int")
    return table(spark, d, "part").where(n % 5 != 0).select(F.col("p_brand").alias("src"), F.concat(F.lit("Brand#"), n + 1).alias("dst")).distinct()


@query(f"WITH RECURSIVE c AS ({CHAIN}), r(skill_id, needs) AS (SELECT dst, src FROM c UNION SELECT r.skill_id, c.src FROM r JOIN c ON r.needs = c.dst) SELECT DISTINCT skill_id, needs FROM r WHERE skill_id <> needs")
def learning_closure(spark, d):
    return match.closure(chain(spark, d))


@query(f"WITH RECURSIVE c AS (SELECT * FROM ({CHAIN}) WHERE src <> 'Brand#3'), r(skill_id, needs) AS (SELECT dst, src FROM c UNION SELECT r.skill_id, c.src FROM r JOIN c ON r.needs = c.dst) SELECT DISTINCT skill_id, needs FROM r WHERE skill_id <> needs")
def learning_closure_open(spark, d):
    """What is still needed by someone who knows Brand#3."""
    return match.closure(chain(spark, d), spark.createDataFrame([("Brand#3",)], "skill_id string"))


@query(f"""{with_(RD, burst_sql('rd', 'role_id', 'b'), PROFILES, SPECS, JUDGED, GAPS).replace('WITH', 'WITH RECURSIVE', 1)}, c AS ({CHAIN}), own AS (SELECT c_custkey AS profile_id, c_mktsegment AS role_id FROM customer),
t AS (SELECT profile_id, skill_id, urgency FROM gp JOIN own USING (profile_id, role_id)),
ok AS (SELECT profile_id, skill_id FROM jd JOIN own USING (profile_id, role_id) WHERE verdict = 'satisfied' AND (profile_id, skill_id) NOT IN (SELECT (profile_id, skill_id) FROM t) UNION
  SELECT profile_id, skill_id FROM pf JOIN own USING (profile_id) WHERE level >= 1 AND (role_id, skill_id) NOT IN (SELECT (role_id, skill_id) FROM sc)),
r(profile_id, skill_id, urgency) AS (SELECT * FROM t UNION SELECT r.profile_id, c.src, r.urgency FROM r JOIN c ON c.dst = r.skill_id WHERE (r.profile_id, c.src) NOT IN (SELECT (profile_id, skill_id) FROM ok)),
m AS (SELECT profile_id, skill_id, max(urgency) AS urgency FROM r GROUP BY ALL)
SELECT profile_id, skill_id, urgency, (profile_id, skill_id) NOT IN (SELECT (profile_id, skill_id) FROM t) AS implicit, coalesce(src, '') AS prerequisites, coalesce((SELECT k.skill_id FROM m k WHERE k.profile_id = m.profile_id AND k.skill_id = src), '') AS blocking FROM m LEFT JOIN c ON dst = skill_id""")
def learning_steps(spark, d):
    """The steps of learning_path without their order, which SQL can't express."""
    return learning_path(spark, d).select("profile_id", "skill_id", "urgency", "implicit", F.array_join("prerequisites", ",").alias("prerequisites"), F.array_join("blocking", ",").alias("blocking"))


@query()
def learning_path(spark, d):
    """Each customer's path to the role of its own segment; what it holds beyond the role's skills counts as known."""
    own = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.col("c_mktsegment").alias("role_id"))
    held, asked = profiles(spark, d), specs(spark, d)
    own = own.join(held.select("profile_id").distinct(), "profile_id", "left_semi")
    judged = match.judge(held, asked, own)
    targets = match.gaps(judged, burst_weights(spark, d)).select("profile_id", "skill_id", "urgency")
    beyond = match.surplus(held.where("level >= 1"), asked, own).select("profile_id", "skill_id")
    known = judged.where("verdict = 'satisfied'").select("profile_id", "skill_id").union(beyond)
    return match.learning_path(targets, chain(spark, d), known)


#: Families of skills and jobs, degrees and years, for the gold rules.
FAMILIES = ["java", "front", "data", "soft", "general"]
JOBS = {"AUTOMOBILE": ("java", "本科", 3), "BUILDING": ("front", "硕士", 5), "FURNITURE": ("data", "不限", None), "HOUSEHOLD": ("java", None, 0), "MACHINERY": ("general", "博士", 8)}
OWN_DEGREES = ["大专", "本科", "硕士", "博士", None, "不限"]


def _sql_case(of: str, values: dict) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k!r} THEN {'NULL' if v is None else repr(v)}" for k, v in values.items()) + " END"


_RANK = "coalesce(CASE {} WHEN '大专' THEN 1 WHEN '本科' THEN 2 WHEN '硕士' THEN 3 WHEN '博士' THEN 4 END, 0)"
GOLD = f"""sk AS (SELECT role_id, skill_id, necessity, CASE CAST(substr(skill_id, 7) AS INT) % 5 {" ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FAMILIES))} END AS family, {_sql_case("role_id", {k: v[0] for k, v in JOBS.items()})} AS job_family FROM sc),
te AS (SELECT *, family = job_family AS dir, CASE WHEN necessity = 'required' THEN 2 ELSE 1 END AS need FROM sk WHERE family <> 'soft'),
ga AS (SELECT role_id, job_family, bool_or(necessity = 'required') AS any_req FROM te GROUP BY ALL),
gn AS (SELECT role_id, ga.job_family, count(*) AS n, count(*) FILTER (dir) AS n_dir FROM te JOIN ga USING (role_id) WHERE necessity = 'required' OR NOT any_req GROUP BY ALL),
gk AS (SELECT profile_id, role_id, count(*) AS ok, count(*) FILTER (dir) AS ok_dir FROM pf JOIN te USING (skill_id) WHERE necessity = 'required' AND level >= need GROUP BY ALL),
fa AS (SELECT profile_id, arg_min(family, (-n, family)) AS own_family FROM (SELECT profile_id, [{", ".join(f"'{f}'" for f in FAMILIES)}][CAST(substr(skill_id, 7) AS INT) % 5 + 1] AS family, count(*) AS n FROM pf GROUP BY ALL) WHERE family NOT IN ('soft', 'general') GROUP BY 1),
cu AS (SELECT c_custkey AS profile_id, {_sql_case("c_nationkey % 6", dict(enumerate(OWN_DEGREES)))} AS own_edu, CASE WHEN c_nationkey % 7 <> 0 THEN c_acctbal / 1000 END AS years FROM customer),
go AS (SELECT pr.profile_id, role_id AS job_id, coalesce(ok, 0) / n AS coverage, CASE WHEN n_dir = 0 THEN 1.0 ELSE coalesce(ok_dir, 0) / n_dir END AS direction_coverage, n_dir - coalesce(ok_dir, 0) AS n_dir_miss, own_family, job_family,
  own_edu, years, {_sql_case("role_id", {k: v[1] for k, v in JOBS.items()})} AS job_edu, {_sql_case("role_id", {k: v[2] for k, v in JOBS.items()})} AS job_years FROM (SELECT DISTINCT profile_id FROM pf) pr CROSS JOIN gn LEFT JOIN gk USING (profile_id, role_id) LEFT JOIN fa USING (profile_id) JOIN cu USING (profile_id)),
gx AS (SELECT *, CASE WHEN job_edu IS NULL OR job_edu = '不限' THEN true WHEN own_edu IS NULL THEN false ELSE {_RANK.format('own_edu')} >= {_RANK.format('job_edu')} END AS edu_ok, CASE WHEN job_years IS NULL OR job_years <= 0 THEN true WHEN years IS NULL THEN false ELSE years >= job_years END AS exp_ok,
  coalesce(own_family IS NOT NULL AND own_family <> job_family AND direction_coverage < 0.2, false) AS family_mismatch FROM go),
gr AS (SELECT *, CASE WHEN family_mismatch THEN 'R1' WHEN coverage < 0.3 THEN 'R2' WHEN coverage < 0.4 AND NOT edu_ok AND NOT exp_ok THEN 'R3' WHEN coverage >= 0.9 AND n_dir_miss = 0 AND (edu_ok OR exp_ok) THEN 'R4' WHEN coverage >= 0.7 AND n_dir_miss <= 1 THEN 'R5' WHEN coverage >= 0.4 THEN 'R6' ELSE 'R7' END AS rule FROM gx),
gt AS (SELECT *, CASE rule WHEN 'R4' THEN 'strong' WHEN 'R5' THEN 'adequate' WHEN 'R6' THEN 'gapped' ELSE 'mismatch' END AS tier FROM gr)"""


@query(f"{with_(RD, PROFILES, SPECS, GOLD)} SELECT profile_id, job_id, coverage, direction_coverage, n_dir_miss, family_mismatch, rule, tier FROM gt")
def gold_tier_rules(spark, d):
    """Segments as jobs: brands have families, customers degrees and years."""
    return gold_tiers(spark, d, kept(match.by_profile(profiles(spark, d))), specs(spark, d))


def gold_tiers(spark, d, own: DataFrame, asked: DataFrame) -> DataFrame:
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.substring("skill_id", 7, 9).cast("int") % 5 + 1)
    of = lambda i, kind: F.element_at(F.create_map(*[x for k, v in JOBS.items() for x in (F.lit(k), F.lit(v[i]).cast(kind))]), F.col("job_id"))
    jobs = asked.withColumnRenamed("role_id", "job_id").select("job_id", of(0, "string").alias("job_family"), "skill_id", family.alias("family"), "necessity", F.lit(None).cast("int").alias("level_hint"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("profile_id"), F.element_at(F.array(*map(F.lit, OWN_DEGREES)), F.col("c_nationkey") % 6 + 1).alias("own_edu"), F.when(F.col("c_nationkey") % 7 != 0, F.col("c_acctbal") / 1000).alias("years"))
    rows = match.gold_coverage(own, jobs).join(match.skill_family(match.each_skill(own).withColumn("family", family)), "profile_id", "left").join(c, "profile_id")
    rows = rows.withColumns({"edu_ok": match.education_fits(F.col("own_edu"), of(1, "string")), "exp_ok": match.experience_fits(F.col("years"), of(2, "int"))})
    return match.gold_tier(rows).select("profile_id", "job_id", "coverage", "direction_coverage", "n_dir_miss", "family_mismatch", "rule", "tier")


@query(f"{with_(RD, PROFILES, SPECS, GOLD)} SELECT profile_id, job_id, CAST(row_number() OVER (PARTITION BY profile_id ORDER BY CASE tier WHEN 'strong' THEN 3 WHEN 'adequate' THEN 2 WHEN 'gapped' THEN 1 ELSE 0 END DESC, coverage DESC, n_dir_miss, job_id) AS INT) AS place FROM gt")
def gold_rank(spark, d):
    return match.rank_jobs(gold_tier_rules(spark, d)).select("profile_id", "job_id", "place")


def sql_redact(x: str) -> str:
    """The rules without look-around: neighbours are put back, and a second pass finds what shares one with the last match."""
    for body in ("[0-9]{17}[0-9Xx]", "1[3-9][0-9]{9}"):
        for _ in range(2):
            x = rf"regexp_replace({x}, '(^|[^0-9]){body}($|[^0-9])', '\1{text.REDACTED}\2', 'g')"
    for pattern in (text.EMAIL, text.CHAT_ID):
        x = f"regexp_replace({x}, '{pattern}', '{text.REDACTED}', 'g')"
    return x


@query(f"SELECT doc_id, {sql_redact('text')} AS redacted FROM documents")
def redact_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text")).alias("redacted"))


@query(r"SELECT p_partkey, regexp_replace(lower(p_name), '[\s()\[\]\-_/\\]+', '', 'g') AS text_key FROM part")
def normalize_text_key(spark, d):
    return table(spark, d, "part").select("p_partkey", text.ascii_key(F.col("p_name")).alias("text_key"))


#: Titles with full-width letters, brackets, dashes and suffixes around a part's name; and what is left of them.
DRESSED = "CASE p_partkey % 4 WHEN 0 THEN '【急聘】 ＪＡＶＡ—' || p_name || '研發工程師' WHEN 1 THEN p_name || ' (Senior) 职位' WHEN 2 THEN p_name || '工程师岗位' ELSE p_name || '产品经理 专员岗' END"
_BARE = r"regexp_replace(lower(p_name), '\s+', '', 'g')"


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '急聘java' || {_BARE} || '开发' WHEN 1 THEN {_BARE} || 'senior' WHEN 2 THEN {_BARE} || '工程师' ELSE {_BARE} || '产品经理专员' END AS title_key FROM part")
def normalize_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_title(F.expr(DRESSED)).alias("title_key"))


#: In order of days, the next canonical row of a title is the first one more than 60 days after the last.
GREEDY = f"""{with_().replace('WITH', 'WITH RECURSIVE', 1)}, f AS (SELECT company, city, source_id, day, min(posting_id) AS first FROM p GROUP BY ALL),
c AS (SELECT company, city, source_id, min(day) AS day FROM f GROUP BY ALL UNION ALL SELECT c.company, c.city, c.source_id, (SELECT min(f.day) FROM f WHERE f.company = c.company AND f.city = c.city AND f.source_id = c.source_id AND f.day > c.day + 60) AS day FROM c WHERE c.day IS NOT NULL),
k AS (SELECT company, city, source_id, c.day, first FROM c JOIN f USING (company, city, source_id, day))
SELECT posting_id, CAST(CASE WHEN first = posting_id THEN NULL ELSE first END AS DOUBLE) AS duplicate_of FROM p ASOF JOIN k ON p.company = k.company AND p.city = k.city AND p.source_id = k.source_id AND p.day >= k.day"""


@query(GREEDY)
def dedup_exact_title(spark, d):
    return text.greedy_duplicates(postings(spark, d).select("posting_id", "day", "company", "city", F.col("source_id").alias("title")), ["company", "city"], least=None).select("posting_id", F.col("duplicate_of").cast("double").alias("duplicate_of"))


@query(GREEDY)
def dedup_fuzzy_title(spark, d):
    """No two of these titles are alike, so the rows are those of equal titles; the tests have alike ones."""
    return text.greedy_duplicates(postings(spark, d).select("posting_id", "day", "company", "city", F.col("source_id").alias("title")), ["company", "city"]).select("posting_id", F.col("duplicate_of").cast("double").alias("duplicate_of"))


@query(f"{with_()} SELECT a.posting_id AS a, b.posting_id AS b, CAST(abs(a.day - b.day) AS BIGINT) AS days FROM p a JOIN p b ON a.company = b.company AND a.city = b.city AND a.posting_id < b.posting_id AND abs(a.day - b.day) <= 60")
def dedup_candidates(spark, d):
    """A band of 60 days: rows meet in their own or the next bucket of that width."""
    p = postings(spark, d).select("posting_id", "company", "city", "day", F.floor(F.datediff("day", F.lit("1990-01-01")) / 60).alias("bucket"))
    near = p.select(F.col("posting_id").alias("other"), "company", "city", F.col("day").alias("other_day"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    days = F.abs(F.datediff("day", "other_day"))
    return p.join(near, ["company", "city", "bucket"]).where((F.col("posting_id") < F.col("other")) & (days <= 60)).select(F.col("posting_id").alias("a"), F.col("other").alias("b"), days.cast("long").alias("days"))


#: Blocks with their marks: a mark is put behind each piece but the last.
BLOCKS = r"""pieces AS (SELECT source, doc_id, md5(text) AS t, unnest(regexp_extract_all(text, '[^。\n]*[。\n]|[^。\n]+$')) AS piece FROM documents WHERE text IS NOT NULL),
bl AS (SELECT source, doc_id, t, regexp_replace(regexp_replace(piece, '^\s+', ''), '\s+$', '') AS block FROM pieces)"""


@query(f"""WITH {BLOCKS} SELECT source, block, count(DISTINCT doc_id) AS n_docs FROM bl WHERE length(block) >= 8 GROUP BY ALL HAVING count(DISTINCT doc_id) > 1""")
def boilerplate_blocks(spark, d):
    return text.shared_blocks(table(spark, d, "documents"), "source")


@query()
def minhash_near_dups(spark, d):
    return text.near_blocks(table(spark, d, "documents"), "source")


@query()
def boilerplate_spans(spark, d):
    """Spans of benefits and of blocks that other documents of the source have, as one string."""
    found = text.boilerplate(table(spark, d, "documents"), "source")
    return found.select("doc_id", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"))


#: Words whose mentions are looked for, as surfaces of skills.
VOCABULARY = {"the": "w.the", "thand": "w.thand", "these": "w.these", "worthless": "w.worthless", "pathetic": "w.pathetic", "License": "w.license", "MIT License": "w.mit", "token": "w.token", "für": "w.fuer"}


@query()
def scan_mentions(spark, d):
    return text.scan(table(spark, d, "documents"), VOCABULARY)


@query()
def first_mention_evidence(spark, d):
    return text.first_mentions(scan_mentions(spark, d))


#: Words for scanning: one surface each, so that the first whole word is found by SQL as well.
PLAIN_WORDS = ["the", "thand", "worthless", "token", "License"]


@query("WITH w AS (SELECT unnest(['" + "', '".join(PLAIN_WORDS) + """']) AS surface)
SELECT doc_id, surface, length(regexp_extract(text, '(^|[^0-9A-Za-z_])' || surface || '($|[^0-9A-Za-z_])')) > 0 AS here, CAST(len(regexp_extract_all(replace(text, ' ', '  '), '(^|[^0-9A-Za-z_])' || surface || '($|[^0-9A-Za-z_])')) AS BIGINT) AS n
FROM documents, w WHERE regexp_matches(text, '(^|[^0-9A-Za-z_])' || surface || '($|[^0-9A-Za-z_])')""")
def mention_counts(spark, d):
    hits = text.scan(table(spark, d, "documents"), {w: w for w in PLAIN_WORDS})
    return hits.groupBy("doc_id", "surface").agg(F.lit(True).alias("here"), F.count("*").alias("n"))


#: All exact places, overlaps included; without one, those of the folded quote (ASCII white space only), mapped back.
PLACES = r"""qu AS (SELECT item_id, text AS quote, regexp_replace(text, '\s', '', 'g') AS flat FROM benchmark WHERE trim(text) <> ''),
ex AS (SELECT item_id, doc_id, i - 1 AS s, i - 1 + length(quote) AS e FROM (SELECT item_id, doc_id, quote, text, unnest(range(1, length(text) - length(quote) + 2)) AS i FROM documents JOIN qu ON contains(text, quote)) WHERE substring(text, i, length(quote)) = quote),
fl AS (SELECT doc_id, text, regexp_replace(text, '\s', '', 'g') AS ft FROM documents),
fp AS (SELECT item_id, doc_id, text, ft, flat FROM fl JOIN qu ON contains(ft, flat) WHERE NOT contains(text, quote)),
fi AS (SELECT *, list_filter(range(1, length(text) + 1), lambda i: NOT regexp_matches(substring(text, i, 1), '\s')) AS ix FROM fp),
fo AS (SELECT item_id, doc_id, ix[k] - 1 AS s, ix[k + length(flat) - 1] AS e FROM (SELECT *, unnest(range(1, length(ft) - length(flat) + 2)) AS k FROM fi) WHERE substring(ft, k, length(flat)) = flat),
f AS (SELECT item_id, doc_id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM ex UNION ALL SELECT item_id, doc_id, CAST(s AS INT), CAST(e AS INT) FROM fo)"""


def benchmark_quotes(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))


@query(f"WITH {PLACES} SELECT * FROM f")
def locate_quotes(spark, d):
    return text.locate(table(spark, d, "documents"), benchmark_quotes(spark, d))


@query(f"WITH {PLACES}, h AS (SELECT *, CAST(item_id * 37 % 1000 AS INT) AS hint FROM f) SELECT item_id, doc_id, arg_min(start, (abs(start - hint), start)) AS start, arg_min(\"end\", (abs(start - hint), start)) AS \"end\" FROM h GROUP BY ALL")
def located_by_hint(spark, d):
    hits = text.locate(table(spark, d, "documents"), benchmark_quotes(spark, d))
    hints = hits.select("item_id", "doc_id").distinct().withColumn("hint", (F.col("item_id") * 37 % 1000).cast("int"))
    return text.pick_places(hits, hints)


@query(f"""{with_()} SELECT skill_id, period, count(DISTINCT source_id) FILTER (conf >= 0.5) AS n_sources, CASE WHEN count(DISTINCT source_id) FILTER (conf >= 0.5) >= 2 THEN 'multi' WHEN count(DISTINCT source_id) FILTER (conf >= 0.5) = 1 THEN 'single' ELSE 'weak' END AS grade
FROM (SELECT skill_id, period, source_id, (posting_id % 10) / 10.0 AS conf FROM p JOIN ms USING (posting_id)) GROUP BY 1, 2""")
def grade_evidence(spark, d):
    e = postings(spark, d).join(mentions(spark, d, True), "posting_id").withColumn("confidence", (F.col("posting_id") % 10) / 10.0)
    return evaluate.grade_evidence(e, ["skill_id", "period"])


@query()
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_text("html").alias("text"))


@query("SELECT event_id, json_keys(props) AS prop_keys FROM (SELECT event_id, CAST(props AS JSON) AS props FROM events WHERE props IS NOT NULL)")
def json_props(spark, d):
    return table(spark, d, "events").where("props is not null").select("event_id", F.json_object_keys("props").alias("prop_keys"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS score FROM q JOIN embeddings ON vec_id <> query_id)
SELECT query_id, vec_id, score, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS place FROM s) WHERE place <= 3""")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return vectors.top_k(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "e"), 3)


LABELLED = "lb AS (SELECT doc_id, lang, quality = 1 AS gold, length(text) >= 300 AS pred FROM documents JOIN labels USING (doc_id))"


def labelled(spark, d) -> DataFrame:
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", (F.col("quality") == 1).alias("gold"), (F.length("text") >= 300).alias("pred"))


@query(f"WITH {LABELLED}, r AS (SELECT count(*) AS n, avg((gold = pred)::INT) AS po, avg(gold::INT) AS pa, avg(pred::INT) AS pb FROM lb), s AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM r) SELECT n, po, pe, CASE WHEN pe >= 1 THEN CASE WHEN po >= 1 THEN 1.0 ELSE 0.0 END ELSE (po - pe) / (1 - pe) END AS kappa FROM s")
def kappa_labels(spark, d):
    return evaluate.kappa(labelled(spark, d).select(F.col("gold").alias("a"), F.col("pred").alias("b")))


@query(f"WITH {LABELLED}, t AS (SELECT lang, CAST(sum((gold AND pred)::INT) AS BIGINT) AS tp, CAST(sum((NOT gold AND pred)::INT) AS BIGINT) AS fp, CAST(sum((gold AND NOT pred)::INT) AS BIGINT) AS fn FROM lb GROUP BY 1) SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM t")
def prf_labels(spark, d):
    return evaluate.precision_recall(labelled(spark, d), ["lang"])


@query(f"""{with_(GD)}, i AS (SELECT skill_id, period, a.weight AS predicted, round(b.weight, 2) AS gold FROM (SELECT * FROM gd WHERE period < '{B}') a JOIN (SELECT skill_id, weight FROM gd WHERE period = '{B}') b USING (skill_id)),
r AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY predicted DESC) + (count(*) OVER (PARTITION BY period, predicted) - 1) / 2 AS rp, rank() OVER (PARTITION BY period ORDER BY gold DESC) + (count(*) OVER (PARTITION BY period, gold) - 1) / 2 AS rg,
  row_number() OVER (PARTITION BY period ORDER BY predicted DESC, skill_id) AS place, row_number() OVER (PARTITION BY period ORDER BY gold DESC, skill_id) AS ideal FROM i)
SELECT period, CASE WHEN count(*) < 2 OR stddev_pop(rp) = 0 OR stddev_pop(rg) = 0 THEN 0.0 ELSE corr(rp, rg) END AS spearman, sum(CASE WHEN place <= 3 THEN gold / log2(place + 1) ELSE 0 END) / sum(CASE WHEN ideal <= 3 THEN gold / log2(ideal + 1) ELSE 0 END) AS ndcg FROM r GROUP BY 1""")
def ndcg_spearman(spark, d):
    o = obs(spark, d, [])
    gold = o.where(F.col("period") == B).select(F.col("skill_id").alias("item"), F.round("weight", 2).alias("gold"))
    return evaluate.rank_measures(o.where(F.col("period") < B).select("period", F.col("skill_id").alias("item"), F.col("weight").alias("predicted")).join(gold, "item"), "period")


QUOTAS = {"1-URGENT": 45, "2-HIGH": 25, "3-MEDIUM": 20, "5-LOW": 10}


@query(f"SELECT o_orderkey, o_orderpriority, place FROM (SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS INT) AS place FROM orders) WHERE place <= CASE o_orderpriority {' '.join(f'WHEN {k!r} THEN {v}' for k, v in QUOTAS.items())} ELSE 0 END")
def stratified_sample(spark, d):
    return evaluate.stratified(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", QUOTAS, "o_orderkey")


_HASH = "sha256(concat_ws('|', CAST(user_id AS VARCHAR), props))"


@query(f"""WITH e AS (SELECT event_type AS source_id, {_HASH} AS content_hash, event_id, event_id < 500 AS old FROM events),
o AS (SELECT source_id, content_hash, event_id, 'known' AS state FROM e WHERE old),
n AS (SELECT source_id, content_hash, min(event_id) AS event_id, 'new' AS state FROM e WHERE NOT old AND (source_id, content_hash) NOT IN (SELECT (source_id, content_hash) FROM o) GROUP BY ALL)
SELECT * FROM o UNION ALL SELECT * FROM n""")
def snapshot_first_seen(spark, d):
    """The first 500 events are known snapshots; of the others, those of a new source and content are added, the first of each."""
    content = F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "props"), 256)
    e = table(spark, d, "events").select(F.col("event_type").alias("source_id"), content.alias("content_hash"), "event_id")
    return ingest.append_new(e.where("event_id < 500").withColumn("state", F.lit("known")), e.where("event_id >= 500").withColumn("state", F.lit("new")), ["source_id", "content_hash"], [F.col("event_id")])


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def posting_upsert_latest(spark, d):
    return text.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, d):
    e = arrivals.read_events(spark, d).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return arrivals.drain(arrivals.first_seen(e, ["user_id", "event_type"], "ts", "60 days")).select("user_id", "event_type")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_obs(spark, d):
    e = arrivals.read_events(spark, d).select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return arrivals.drain(arrivals.daily(e, ["event_type"], "ts"), ["day", "event_type"])


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def stream_quarterly_obs(spark, d):
    o = arrivals.read_events(spark, d, "orders").select("o_orderpriority", F.col("o_orderdate").cast("timestamp").alias("ts"))
    return arrivals.drain(arrivals.quarterly(o, ["o_orderpriority"], "ts"), ["period", "o_orderpriority"])


@query(GREEDY)
def stream_duplicates(spark, d):
    """The orders as a stream, its blocks the customers (one nation each)."""
    o = arrivals.read_events(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"), F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("title"), F.to_date("o_orderdate").cast("timestamp").alias("ts"))
    return arrivals.drain(arrivals.duplicates(o, ["company"])).select("posting_id", F.col("duplicate_of").cast("double").alias("duplicate_of"))


@query("""SELECT 'broken_parent' AS "check", count(*) AS n FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) UNION ALL SELECT 'own_parent', 0 UNION ALL SELECT 'repeated_id', count(*) FROM (SELECT r_regionkey FROM region GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'alias_conflict', count(*) FROM (SELECT lower(p_name) FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) > 1)""")
def ontology_checks(spark, d):
    parents = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"))
    ids = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"))
    return evaluate.hierarchy_checks(parents, ids, table(spark, d, "part").select(F.lower("p_name").alias("alias"), F.col("p_partkey").alias("id")))
