"""Queries on boards, ingest, extraction, pages, samples and vocabularies, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vacancy
from ..operators import evaluate, extract, graph, ingest, match, observe, pages, vocabulary
from ..sources import boards
from ..sources.shared import kept
from ..sources.tables import mentions, postings, table
from .evolution import A, B, GD, OTHER, RD, ROLE, RS, obs, with_
from .profiles import DRESSED, GOLD, JUDGED, METRICS, PLAIN_WORDS, PROFILES, SPECS, TIERS, _BARE, gold_tiers, profiles, specs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Boards


def responses(spark, d) -> DataFrame:
    """A response for each brand with its parts as vacancies."""
    job = F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("1999-02-0"), (F.col("p_partkey") % 9 + 1).cast("string")).alias("updated_at"), F.lit("x").alias("bossName")))
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("token")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", job.alias("j")))), lambda x: x["j"]), ",").alias("jobs"))
    return p.select("token", F.lower("token").alias("name"), F.lit("u").alias("url"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"), F.concat(F.lit('{"jobs":['), "jobs", F.lit("]}")).alias("body"))


_PAYLOAD = """'{"board_name":"' || lower(p_brand) || '","board_token":"' || p_brand || '","job":{"id":' || p_partkey || ',"title":"' || p_name || '","updated_at":"1999-02-0' || (p_partkey % 9 + 1) || '"}}'"""


@query(f"SELECT 'greenhouse:' || sha256(x) AS id, 'greenhouse' AS source_id, 'u' AS url, sha256(x) AS content_hash, x AS payload FROM (SELECT {_PAYLOAD} AS x FROM part WHERE p_partkey % 9 + 1 >= 4)")
def greenhouse_snapshots(spark, d):
    return boards.greenhouse(responses(spark, d), "1999-02-04").drop("fetched_at")


@query("""WITH j AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 2, p_partkey) AS n FROM part)
SELECT p_brand AS org_id, CAST(p_partkey AS VARCHAR) AS job_id, CASE p_partkey % 2 WHEN 0 THEN 'social' ELSE 'campus' END AS mode FROM j WHERE n <= 5""")
def moka_capped(spark, d):
    """The first five vacancies of each organisation, of mode social before campus."""
    job = F.to_json(F.struct(F.col("p_partkey").alias("id")))
    mode = F.when(F.col("p_partkey") % 2 == 0, "social").otherwise("campus")
    p = table(spark, d, "part").select(F.col("p_brand").alias("org_id"), mode.alias("mode"), F.col("p_partkey").alias("offset"), F.concat(F.lit('{"jobs":['), job, F.lit("]}")).alias("body"))
    p = p.withColumns({"org_name": F.col("org_id"), "url": F.lit("u"), "fetched_at": F.lit(None).cast("timestamp")})
    got = boards.moka(p, per_org=5)
    part = lambda path, name: F.get_json_object("payload", path).alias(name)
    return got.select(part("$.org_id", "org_id"), part("$.job.id", "job_id"), part("$.mode", "mode"))


@query("SELECT event_id, sha256('{\"k\":' || regexp_extract(props, '[0-9]+') || ',\"list\":[{\"a\":1}]}') AS content_hash FROM events WHERE regexp_matches(props, '^\\{\"k\": [0-9]+\\}$')")
def content_hashes(spark, d):
    """Properties as payloads, with personal keys at two depths that go."""
    k = F.regexp_extract("props", "[0-9]+", 0)
    raw = F.concat(F.lit('{"list": [{"jobManager": "x", "a": 1}], "k": '), k, F.lit(', "aae005": "1"}'))
    return table(spark, d, "events").where(F.col("props").rlike(r'^\{"k": [0-9]+\}$')).select("event_id", boards.content_hash(raw).alias("content_hash"))


@query("SELECT token, arg_min(name, place) AS name FROM (SELECT r_name AS token, 'region' AS name, 0 AS place FROM region UNION ALL SELECT n_name, 'nation', 1 FROM nation UNION ALL SELECT DISTINCT c_mktsegment, 'segment', 2 FROM customer UNION ALL SELECT n_name, 'again', 3 FROM nation) GROUP BY 1")
def merged_lists(spark, d):
    one = lambda name, c, said: table(spark, d, name).select(F.col(c).alias("token"), F.lit(said).alias("name")).distinct()
    return boards.merge_lists([one("region", "r_name", "region"), one("nation", "n_name", "nation"), one("customer", "c_mktsegment", "segment"), one("nation", "n_name", "again")])


# Ingest


@query(f"""WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN {_BARE} WHEN 1 THEN {_BARE} WHEN 2 THEN {_BARE} || '工程师' ELSE {_BARE} || '产品经理专员' END AS key, p_name FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ＪＡＶＡ' WHEN 1 THEN p_name || '  职位' WHEN 2 THEN p_name || '工程师岗位' ELSE p_name || '产品经理 专员岗' END AS plain, 'role.' || substr(sha1(CASE WHEN p_partkey % 4 = 0 THEN 'java' ELSE key END), 1, 10) AS role_id FROM k""")
def role_ids(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.expr(DRESSED).alias("title"))
    return p.select("p_partkey", ingest.plain_title(F.col("title")).alias("plain"), ingest.role_id(F.col("title")).alias("role_id"))


@query("""WITH o AS (SELECT o_custkey AS posting_id, o_orderkey, o_orderpriority AS title, o_orderdate, o_orderkey % 3 = 0 AS new FROM orders),
e AS (SELECT * FROM o WHERE NOT new QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY o_orderkey) = 1), n AS (SELECT * FROM o WHERE new QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY o_orderkey DESC) = 1)
SELECT posting_id, o_orderkey, title FROM n UNION ALL SELECT posting_id, o_orderkey, title FROM e WHERE posting_id NOT IN (SELECT posting_id FROM n)""")
def posting_sink(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("posting_id"), "o_orderkey", F.col("o_orderpriority").alias("title"))
    first = ingest._first(o.where("o_orderkey % 3 <> 0"), ["posting_id"], [F.col("o_orderkey")])
    return ingest.upsert(first, o.where("o_orderkey % 3 = 0"), ["posting_id"], [F.desc("o_orderkey")])


@query("SELECT o_orderkey AS posting_id, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN '4notspecified' ELSE lower(replace(o_orderpriority, '-', '')) END AS title_normalized, CASE WHEN o_orderkey % 5 > 0 THEN CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) END AS period FROM orders")
def stored_postings(spark, d):
    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"), F.col("o_orderpriority").alias("title"), F.when(F.col("o_orderkey") % 5 > 1, day).alias("published_at"), F.when(F.col("o_orderkey") % 5 > 0, day).alias("updated_at"))
    return ingest.with_keys(o).select("posting_id", "title_normalized", "period")


@query("SELECT o_orderkey AS posting_id, o_orderdate::DATE::VARCHAR AS published_at FROM orders WHERE o_orderkey % 4 <> 0")
def canonical_postings(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"), F.to_date("o_orderdate").alias("published_at"), F.when(F.col("o_orderkey") % 4 == 0, F.lit(1)).alias("duplicate_of"))
    return ingest.canonical(o).select("posting_id", F.col("published_at").cast("string").alias("published_at"))


@query("SELECT count(*) AS n_postings, count(*) FILTER (o_orderkey % 4 <> 0) AS n_canonical FROM orders")
def posting_totals(spark, d):
    return ingest.totals(table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 4 == 0, F.lit(1)).alias("duplicate_of")))


@query("SELECT event_id FROM events WHERE props IN (SELECT props FROM events WHERE event_type = 'click')")
def known_snapshots(spark, d):
    """Events whose content a click has, of whatever type."""
    e = table(spark, d, "events").select("event_id", "event_type", F.col("props").alias("content_hash"))
    return ingest.known(e, e.where("event_type = 'click'")).select("event_id")


TITLED = "SELECT doc_id, text, source, 'Engineer (' || coalesce(lang, '') || ') of ' || coalesce(source, '') || ' — now' AS title, DATE '2024-01-01' + CAST(doc_id % 300 AS INT) AS day FROM documents"
FOUND = f"""w AS (SELECT unnest(['{"', '".join(PLAIN_WORDS)}']) AS skill_id), td AS (SELECT *, 'role.' || substr(sha1(replace(lower('Engineer  of ' || coalesce(source, '')), ' ', '')), 1, 10) AS role_id,
  '2024Q' || quarter(day) AS period FROM ({TITLED}) WHERE text <> '' AND doc_id % 7 <> 0),
tt AS (SELECT role_id, period, count(*) AS total FROM td GROUP BY ALL), tn AS (SELECT role_id, skill_id, period, count(*) AS n FROM td, w WHERE regexp_matches(text, '(^|[^0-9A-Za-z_])' || skill_id || '($|[^0-9A-Za-z_])') GROUP BY ALL)"""


def documents_as_postings(spark, d) -> DataFrame:
    """Every seventh is a duplicate; every fifth has no day of publishing, but one of its update."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    title = F.concat(F.lit("Engineer ("), lang, F.lit(") of "), source, F.lit(" — now"))
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("posting_id"), F.col("source").alias("source_id"), title.alias("title"), F.col("text").alias("description"), F.when(F.col("doc_id") % 5 != 0, day).alias("published_at"), day.alias("updated_at"), F.when(F.col("doc_id") % 7 == 0, "1").alias("duplicate_of"))


def words(spark) -> DataFrame:
    """A vocabulary of words, each with an alias that is too ambiguous."""
    return spark.createDataFrame([(w, w, [w, "of" if w == "the" else "is"]) for w in PLAIN_WORDS], "id string, name string, surfaces array<string>")


@query(f"WITH {FOUND} SELECT role_id, skill_id, period, n / total AS weight, n AS posting_count, total AS total_postings FROM tn JOIN tt USING (role_id, period)")
def pipeline_observations(spark, d):
    found = ingest.run_pipeline(spark.createDataFrame([], "id string"), documents_as_postings(spark, d), words(spark), "2026Q3", "0.1")
    return found["observations"].drop("ontology_version")


@query(f"WITH {FOUND}, x AS (SELECT doc_id, skill_id, text, regexp_extract(text, '(?s)^(.*?)(?:^|[^0-9A-Za-z_])' || skill_id || '(?:$|[^0-9A-Za-z_])', 1) AS before, starts_with(text, skill_id) AND NOT regexp_matches(substr(text, length(skill_id) + 1, 1), '[0-9A-Za-z_]') AS here FROM td, w WHERE regexp_matches(text, '(^|[^0-9A-Za-z_])' || skill_id || '($|[^0-9A-Za-z_])')) SELECT CAST(doc_id AS VARCHAR) AS posting_id, skill_id, CAST(CASE WHEN here THEN 0 ELSE length(before) + 1 END AS INT) AS span_start FROM x")
def pipeline_evidence(spark, d):
    found = ingest.run_pipeline(spark.createDataFrame([], "id string"), documents_as_postings(spark, d), words(spark), "2026Q3", "0.1")
    return found["evidence"].select("posting_id", F.substring_index("extractor", ":", -1).alias("skill_id"), "span_start")


@query(f"WITH {FOUND} SELECT DISTINCT role_id AS id, 'Engineer  of ' || source AS name, 'role' AS kind FROM tn JOIN td USING (role_id) UNION SELECT DISTINCT skill_id, skill_id, 'skill' FROM tn")
def pipeline_graph(spark, d):
    found = ingest.run_pipeline(spark.createDataFrame([], "id string"), documents_as_postings(spark, d), words(spark), "2026Q3", "0.1")
    return found["role"].select(F.col("role_id").alias("id"), "name", F.lit("role").alias("kind")).unionByName(found["skill"].select(F.col("skill_id").alias("id"), "name", F.lit("skill").alias("kind")))


@query(f"""{with_(RD, GD)}, n AS (SELECT role_id, skill_id, period, weight / 2 AS weight FROM rd WHERE period = '{B}' UNION ALL SELECT NULL, skill_id, period, weight / 2 FROM gd WHERE period = '{B}')
SELECT role_id, skill_id, period, weight FROM n UNION ALL SELECT role_id, skill_id, period, weight FROM rd WHERE period <> '{B}' UNION ALL SELECT NULL, skill_id, period, weight FROM gd WHERE period <> '{B}'""")
def observation_sink(spark, d):
    """Role and global observations, those of one period put again with half the weight."""
    every = obs(spark, d, ["role_id"]).unionByName(obs(spark, d, []).withColumn("role_id", F.lit(None).cast("string"))).withColumn("ontology_version", F.lit("0.1"))
    return ingest.put_observations(every, every.where(F.col("period") == B).withColumn("weight", F.col("weight") / 2)).select("role_id", "skill_id", "period", "weight")


@query("SELECT DISTINCT p_brand AS competency_id, p_type AS skill_id FROM part WHERE p_brand >= 'Brand#2' UNION SELECT DISTINCT p_brand, 'ALL' FROM part WHERE p_brand < 'Brand#2'")
def edges_replaced(spark, d):
    covers = table(spark, d, "part").select(F.col("p_brand").alias("competency_id"), F.col("p_type").alias("skill_id")).distinct()
    touched = covers.where("competency_id < 'Brand#2'")
    return ingest.replace_edges(covers, touched, touched.withColumn("skill_id", F.lit("ALL")), "competency_id")


CHANGES = "ch AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS competency_id, CAST(ts AS DATE) AS occurred_on, ts FROM events)"


@query(f"WITH {CHANGES} SELECT event_type AS role_id, competency_id, max(event_id) AS change_id FROM ch WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY event_type, competency_id, occurred_on")
def changes_as_of(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("change_id"), F.col("event_type").alias("role_id"), F.col("user_id").cast("string").alias("competency_id"), F.to_date("ts").alias("occurred_on"), F.col("ts").cast("timestamp").alias("recorded_at"), F.lit(False).alias("superseded"))
    every = pages.put_changes(log.where("change_id % 2 = 0"), log.where("change_id % 2 = 1"))
    return pages.as_of(every, "2024-01-15 00:00:00").select("role_id", "competency_id", "change_id")


# Extraction


def replies(spark, d) -> DataFrame:
    """A reply on each document: a statement from its beginning, a surface from further on, and a quote that isn't there."""
    item = lambda quote, **more: F.struct(quote.alias("quote"), *[x.alias(k) for k, x in more.items()])
    need = F.element_at(F.array(F.lit("bonus"), F.lit("required"), F.lit("odd")), (F.col("doc_id") % 3 + 1).cast("int"))
    skill = item(F.substring("text", 31, 12), surface_form=F.lit("S"), necessity=need)
    body = F.to_json(F.struct(F.array(item(F.substring("text", 1, 25), statement=F.lit("T"), necessity=need)).alias("competencies"), F.array(skill, item(F.lit("nowhere ☃"), surface_form=F.lit("N"), necessity=need)).alias("skills")))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("content"))


NEED = "CASE doc_id % 3 WHEN 0 THEN 'bonus' ELSE 'required' END"


@query(rf"""WITH q AS (SELECT doc_id, text, substr(text, 1, 25) AS quote, 'competency' AS kind, 'T' AS said FROM documents UNION ALL SELECT doc_id, text, substr(text, 31, 12), 'skill', 'S' FROM documents)
SELECT doc_id, kind, said AS text, {NEED} AS necessity, CAST(strpos(text, quote) - 1 AS INT) AS start, CAST(strpos(text, quote) - 1 + length(quote) AS INT) AS "end" FROM q
WHERE NOT regexp_matches(quote, '^\s*$') AND NOT (strpos(text, quote) - 1 < 20 AND strpos(text, quote) - 1 + length(quote) > 10 AND doc_id % 11 = 0)""")
def claims_of_replies(spark, d):
    """Claims of model replies; of every eleventh document, characters 10 to 20 are boilerplate."""
    spans = F.when(F.col("doc_id") % 11 == 0, F.array(F.struct(F.lit(10).alias("start"), F.lit(20).alias("end"))))
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("source_id"), "text", spans.alias("boilerplate_spans"))
    claims, _ = extract.extract_posting(replies(spark, d), docs)
    return claims.select("doc_id", "kind", "text", "necessity", "start", "end")


@query(f"""WITH w AS (SELECT unnest(['{"', '".join(PLAIN_WORDS)}']) AS skill_id) SELECT doc_id, skill_id, 0 AS level, CAST(len(regexp_extract_all(replace(text, ' ', '  '), '(^|[^0-9A-Za-z_])' || skill_id || '($|[^0-9A-Za-z_])')) AS BIGINT) AS n_evidence
FROM documents, w WHERE regexp_matches(text, '(^|[^0-9A-Za-z_])' || skill_id || '($|[^0-9A-Za-z_])')""")
def resume_profiles(spark, d):
    """Documents as resumes; what the replies name is no skill of the vocabulary."""
    skills, _, _ = extract.extract_resume(table(spark, d, "documents").select("doc_id", "text"), replies(spark, d), words(spark))
    return skills.select("doc_id", "skill_id", "level", "n_evidence")


@query("""WITH f AS (SELECT DISTINCT p_brand AS skill_id, p_name AS form FROM part UNION SELECT DISTINCT p_brand, p_brand FROM part), s AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE ' ' || p_name END AS surface FROM part UNION SELECT 'unknown thing'),
k AS (SELECT surface, min(skill_id) AS exact FROM s JOIN f ON trim(surface) = form GROUP BY 1), l AS (SELECT surface, min(skill_id) AS folded FROM s JOIN f ON lower(trim(surface)) = lower(form) WHERE length(form) > 3 GROUP BY 1)
SELECT surface, coalesce(exact, folded) AS skill_id, CASE WHEN coalesce(exact, folded) IS NULL THEN 'adjudicator' ELSE 'exact' END AS decided_by, CASE WHEN coalesce(exact, folded) IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence FROM s LEFT JOIN k USING (surface) LEFT JOIN l USING (surface)""")
def normalized_surfaces(spark, d):
    p = table(spark, d, "part")
    vocabulary = p.groupBy(F.col("p_brand").alias("id")).agg(F.sort_array(F.collect_set("p_name")).alias("names")).select("id", F.col("id").alias("name"), F.concat(F.array("id"), "names").alias("surfaces"))
    s = p.select(F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.concat(F.lit(" "), "p_name")).alias("surface")).union(spark.createDataFrame([("unknown thing",)], "surface string"))
    return extract.normalize_surfaces(s, vocabulary)


def brands(spark, d) -> DataFrame:
    """Brands as skills, named by themselves and by their parts."""
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("id")).agg(F.sort_array(F.collect_set("p_name")).alias("names"))
    return p.select("id", F.col("id").alias("name"), F.concat(F.array("id"), "names").alias("surfaces"))


@query()
def recall_candidates(spark, d):
    """The candidates of surfaces that are like names of parts, but none of them."""
    p = table(spark, d, "part").where("p_name is not null")
    s = p.select(F.concat(F.substring("p_name", 2, 40), F.lit(" "), F.substring("p_type", 1, 3)).alias("surface"))
    return extract.recalled(s, brands(spark, d))


@query("""WITH f AS (SELECT DISTINCT p_brand AS skill_id, string_split(p_name, ' ') AS w FROM part), s AS (SELECT DISTINCT 'zz ' || p_name AS surface, string_split('zz ' || p_name, ' ') AS x FROM part)
SELECT surface, min(skill_id) AS skill_id, 'adjudicator' AS decided_by, 0.75::DOUBLE AS confidence FROM s JOIN f ON list_has_all(x, w) GROUP BY surface""")
def adjudicated_surfaces(spark, d):
    """Surfaces with a word too many: an adjudicator that takes the first candidate, of which all words are in the surface."""
    first = lambda candidates: candidates.where("place = 1").select("surface", "skill_id", F.lit(0.75).alias("confidence"))
    s = table(spark, d, "part").select(F.concat(F.lit("zz "), "p_name").alias("surface"))
    return extract.normalize_surfaces(s, brands(spark, d), adjudicate=first)


# Pages

SKILLS = "sk AS (SELECT DISTINCT p_brand || '/' || p_type AS skill_id, CASE WHEN p_brand < 'Brand#2' THEN NULL ELSE 'Brand#1/' || p_type END AS parent_id, CASE WHEN p_type <> 'PROMO' THEN p_type END AS cluster_id FROM part)"
ROLES = "ro AS (SELECT DISTINCT c_mktsegment AS role_id, 'The ' || c_mktsegment AS name, c_mktsegment < 'F' AS is_emerging, CASE WHEN c_mktsegment < 'C' THEN 'published' ELSE 'unverified' END AS state, length(c_mktsegment) / 14.0 AS signal_strength FROM customer)"


def skills(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.concat_ws("/", "p_brand", "p_type").alias("skill_id"), F.concat(F.lit("skill "), "p_brand").alias("name"), F.when(F.col("p_brand") >= "Brand#2", F.concat(F.lit("Brand#1/"), "p_type")).alias("parent_id"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("cluster_id")).distinct()


def clusters(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_type < 'P'").select(F.col("p_type").alias("cluster_id"), F.lower("p_type").alias("name")).distinct()


def roles(spark, d) -> DataFrame:
    c = F.col("c_mktsegment")
    return table(spark, d, "customer").select(c.alias("role_id"), F.concat(F.lit("The "), c).alias("name"), (c < "F").alias("is_emerging"), F.when(c < "C", "published").otherwise("unverified").alias("state"), (F.length(c) / 14).alias("signal_strength"), F.substring(c, 1, 1).alias("family_id")).distinct()


@query(f"WITH {SKILLS}, n AS (SELECT DISTINCT p_brand || '/' || p_type AS parent_id, 'skill ' || p_brand AS parent_name FROM part) SELECT skill_id, 'skill ' || split_part(skill_id, '/', 1) AS name, parent_id, parent_name, cluster_id, CASE WHEN cluster_id < 'P' THEN lower(cluster_id) END AS cluster_name FROM sk LEFT JOIN n USING (parent_id)")
def skill_details(spark, d):
    return pages.skill_detail(skills(spark, d), clusters(spark, d))


@query(f"""{with_(RS)}, co AS (SELECT DISTINCT p_type || ':' || c_mktsegment AS competency_id, c_mktsegment AS role_id, p_type FROM part, customer WHERE length(p_type) + length(c_mktsegment) <> 14)
SELECT role_id, rs.skill_id, weight, competency_id FROM rs LEFT JOIN co ON co.role_id = rs.role_id AND co.p_type = split_part(rs.skill_id, '/', 2) WHERE period = '{B}'""".replace("SELECT role_id, rs.skill_id", "SELECT rs.role_id, rs.skill_id"))
def covered_requirements(spark, d):
    """Types as competencies of some roles; what a competency of another role covers isn't covered."""
    t = table(spark, d, "part").select("p_type", F.concat_ws("/", "p_brand", "p_type").alias("skill_id")).distinct()
    c = t.select("p_type").distinct().crossJoin(table(spark, d, "customer").select(F.col("c_mktsegment").alias("role_id")).distinct()).where("length(p_type) + length(role_id) <> 14").withColumn("competency_id", F.concat_ws(":", "p_type", "role_id"))
    return pages.covered_requirements(obs(spark, d, ["role_id"], True), c, c.join(t, "p_type"), B)


_HERE = f"{with_(RS, SKILLS, ROLES)}, hs AS (SELECT DISTINCT skill_id FROM rs WHERE period = '{B}'), hr AS (SELECT DISTINCT role_id FROM rs WHERE period = '{B}'), k AS (SELECT * FROM hs LEFT JOIN sk USING (skill_id))"
_LEVEL = "CASE WHEN parent_id IS NULL THEN 'level.foundation' ELSE 'level.method' END"


@query(f"""{_HERE} SELECT DISTINCT cluster_id AS id, 'cluster' AS kind, CASE WHEN cluster_id < 'P' THEN lower(cluster_id) ELSE cluster_id END AS label, NULL AS parent, false AS emerging, false AS candidate FROM k WHERE cluster_id IS NOT NULL
UNION ALL SELECT skill_id, 'skill', 'skill ' || split_part(skill_id, '/', 1), cluster_id, false, false FROM k UNION ALL SELECT role_id, 'role', name, NULL, is_emerging AND state = 'published', state = 'unverified' FROM hr JOIN ro USING (role_id)""")
def overview_nodes(spark, d):
    return pages.overview_nodes(obs(spark, d, ["role_id"], True), roles(spark, d), skills(spark, d), clusters(spark, d), B).drop("level")


@query(f"""{_HERE}, there AS (SELECT skill_id AS id FROM hs UNION SELECT cluster_id FROM k) SELECT 'member:' || skill_id AS id, cluster_id AS source, skill_id AS target, 'member' AS kind FROM k WHERE cluster_id IS NOT NULL
UNION ALL SELECT 'parent:' || skill_id, parent_id, skill_id, 'parent' FROM k WHERE parent_id IN (SELECT id FROM there WHERE id IS NOT NULL) UNION ALL SELECT 'requires:' || role_id || ':' || skill_id, role_id, skill_id, 'requires' FROM rs WHERE period = '{B}'""")
def overview_edges(spark, d):
    return pages.overview_edges(obs(spark, d, ["role_id"], True), skills(spark, d), B)


@query(f"{_HERE} SELECT 'level.foundation' AS id, '基础层' AS label, NULL AS parent UNION ALL SELECT 'level.method', '方法层', NULL UNION ALL SELECT skill_id, 'skill ' || split_part(skill_id, '/', 1), {_LEVEL} FROM k UNION ALL SELECT role_id, name, NULL FROM hr JOIN ro USING (role_id)")
def overview_levels(spark, d):
    return pages.overview_nodes(obs(spark, d, ["role_id"], True), roles(spark, d), skills(spark, d), clusters(spark, d), B, "level").select("id", "label", "parent")


@query(f"{with_(RD)} SELECT role_id, skill_id, weight FROM rd WHERE period = '{B}' AND role_id < 'C' AND substr(role_id, 1, 1) = 'A' AND weight >= 0.1 AND weight < 0.3 ORDER BY weight DESC, role_id, skill_id LIMIT 200")
def panorama_filtered(spark, d):
    return pages.panorama_of(obs(spark, d, ["role_id"]), roles(spark, d), B, "A", "low", 0.1, 200, True)


@query(f"{with_(RS)} SELECT skill_id, weight FROM rs WHERE role_id = '{ROLE}' AND period = '{B}'")
def me_required(spark, d):
    return pages.me_home(obs(spark, d, ["role_id"], True), ROLE, B, A)[0]


@query(f"""{with_(RS)}, m AS (SELECT skill_id, a.weight - coalesce(b.weight, 0) AS raw FROM (SELECT * FROM rs WHERE role_id = '{ROLE}' AND period = '{B}') a LEFT JOIN (SELECT * FROM rs WHERE role_id = '{ROLE}' AND period = '{A}') b USING (skill_id)),
r AS (SELECT skill_id, round(raw, 4) AS delta, CASE WHEN raw > 0.02 THEN 'rise' ELSE 'fall' END AS direction FROM m WHERE raw > 0.02 OR raw < -0.02)
SELECT skill_id, delta, direction, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY direction ORDER BY abs(delta) DESC, skill_id) AS INT) AS place FROM r) WHERE place <= 8""")
def me_moves(spark, d):
    return pages.me_home(obs(spark, d, ["role_id"], True), ROLE, B, A)[1]


@query(f"{with_(RS)}, c AS (SELECT skill_id, a.weight - coalesce(b.weight, a.weight) AS raw FROM (SELECT * FROM rs WHERE role_id = '{OTHER}' AND period = '{B}') a LEFT JOIN (SELECT * FROM rs WHERE role_id = '{OTHER}' AND period = '{A}') b USING (skill_id)) SELECT skill_id, round(raw, 6) AS delta, CASE WHEN raw > 0.015 THEN 'rise' WHEN raw < -0.01 THEN 'fall' ELSE 'flat' END AS direction FROM c")
def mock_moves(spark, d):
    return pages.mock_moves(obs(spark, d, ["role_id"], True).where(F.col("role_id") == OTHER), B, A)


@query(f"WITH {ROLES}, e AS (SELECT c_mktsegment AS role_id, count(*) AS evidence_count FROM customer WHERE c_acctbal > 9000 GROUP BY 1) SELECT role_id, CASE WHEN signal_strength >= 0.65 THEN 'strong' WHEN signal_strength >= 0.4 THEN 'medium' ELSE 'weak' END AS signal_band, coalesce(evidence_count, 0) AS evidence_count FROM ro LEFT JOIN e USING (role_id) WHERE state = 'unverified'")
def candidate_cards(spark, d):
    e = table(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_mktsegment").alias("role_id"))
    return pages.candidate_cards(roles(spark, d), e).select("role_id", "signal_band", "evidence_count")


@query(f"{with_(RD)} SELECT skill_id, sum(weight) AS total_weight FROM rd WHERE period = '{B}' GROUP BY 1 ORDER BY round(sum(weight), 9) DESC, 1 LIMIT 12")
def market_top(spark, d):
    covers = table(spark, d, "part").select(F.col("p_brand").alias("skill_id"), F.col("p_type").alias("competency")).where("false")
    return pages.market(obs(spark, d, ["role_id"]), roles(spark, d), covers, B, A)["top"]


@query(f"{with_(RD)} SELECT role_id FROM rd WHERE skill_id = 'Brand#11' AND period = '{B}'")
def skill_page_roles(spark, d):
    return pages.skill_page(obs(spark, d, ["role_id"]), "Brand#11", B)[2]


# Evaluation and vocabularies


@query(f"{with_(RD, PROFILES, SPECS, JUDGED, METRICS, TIERS, GOLD)} SELECT count(*) AS n, avg((gt.tier IS NOT DISTINCT FROM ti.tier)::INT) AS accuracy FROM gt LEFT JOIN (SELECT profile_id, role_id AS job_id, tier FROM ti WHERE profile_id % 3 > 0) ti USING (profile_id, job_id)")
def tier_agreement(spark, d):
    """The product's tiers against the gold rules' ones; a third of the profiles has no prediction."""
    own, asked = kept(match.by_profile(profiles(spark, d))), kept(specs(spark, d))
    pred = match.tier(match.metrics(own.where("profile_id % 3 > 0"), asked)).withColumnRenamed("role_id", "job_id")
    return evaluate.tier_accuracy(gold_tiers(spark, d, own, asked), pred, ["profile_id", "job_id"])


@query(f"{with_(RD, PROFILES, SPECS, JUDGED)} SELECT count(*) AS n, avg((verdict = 'satisfied' AND ascii(right(skill_id, 1)) % 2 = 0)::INT) AS accuracy FROM jd WHERE profile_id % 3 > 0")
def verdict_agreement(spark, d):
    """Every predicted verdict is satisfied; there are ones for even skills only, and for two thirds of the profiles."""
    gold = match.judge_pairs(kept(match.by_profile(profiles(spark, d))), specs(spark, d))
    said = lambda v: F.struct(v["skill_id"].alias("skill_id"), F.when(F.ascii(F.right(v["skill_id"], F.lit(1))) % 2 == 0, "satisfied").alias("verdict"))
    pred = gold.where("profile_id % 3 > 0").withColumn("verdicts", F.transform("verdicts", said))
    return evaluate.verdict_accuracy_of_pairs(gold, pred, ["profile_id", "role_id"])


@query("""WITH l AS (SELECT lang, quality = 1 AS g, length(text) >= 300 AS p FROM documents JOIN labels USING (doc_id)), t AS (SELECT lang, sum((g AND p)::INT) AS tp, sum((NOT g AND p)::INT) AS fp, sum((g AND NOT p)::INT) AS fn FROM l GROUP BY 1),
m AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS macro_f1 FROM t) SELECT tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1, macro_f1 FROM m""")
def micro_macro_labels(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", (F.col("quality") == 1).alias("gold"), (F.length("text") >= 300).alias("pred"))
    return evaluate.micro_macro(j, "lang")


SHARES = {"gapped": 0.45, "adequate": 0.25, "mismatch": 0.2, "strong": 0.1}
_TIER = "CASE o_orderpriority WHEN '1-URGENT' THEN 'gapped' WHEN '2-HIGH' THEN 'adequate' WHEN '3-MEDIUM' THEN 'mismatch' WHEN '5-LOW' THEN 'strong' END"


@query(f"""WITH r AS (SELECT o_orderkey, {_TIER} AS tier FROM orders WHERE {_TIER} <> 'mismatch' OR o_orderkey < 100), p AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS place FROM r WHERE tier IS NOT NULL),
q AS (SELECT *, CASE WHEN place <= CASE tier WHEN 'gapped' THEN 91 WHEN 'adequate' THEN 50 WHEN 'mismatch' THEN 40 ELSE 20 END THEN 0 ELSE CASE tier WHEN 'gapped' THEN 1 WHEN 'adequate' THEN 2 WHEN 'mismatch' THEN 3 ELSE 4 END END AS turn FROM p)
SELECT o_orderkey, tier FROM q ORDER BY turn, place, tier LIMIT 201""")
def filled_sample(spark, d):
    """201 orders by shares; mismatch has too few, so that leftovers fill up."""
    r = table(spark, d, "orders").select("o_orderkey", F.expr(_TIER).alias("tier")).where("tier <> 'mismatch' or o_orderkey < 100")
    return evaluate.filled_sample(r, 201, SHARES, "gapped", "o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS turn FROM orders) ORDER BY turn, o_orderpriority, o_orderstatus LIMIT 128")
def round_robin_sample(spark, d):
    return evaluate.round_robin(table(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], 128, "o_orderkey").select("o_orderkey")


_JD = "CASE p_partkey % 4 WHEN 0 THEN '高级工程师，本科及以上，' || p_size || '-' || (p_size + 2) || '年，15-30K' WHEN 1 THEN '招聘 Principal, ' || p_size || ' 年以上，学历不限，1.5-2万' WHEN 2 THEN '应届生，硕士或研究生' ELSE '实习助理，专科' END"


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '本科' WHEN 1 THEN '不限' WHEN 2 THEN '硕士' ELSE '大专' END AS degree,
CASE WHEN p_partkey % 5 = 0 THEN '2-4年' WHEN p_partkey % 4 = 0 THEN p_size || '-' || (p_size + 2) || '年' WHEN p_partkey % 4 = 1 THEN p_size || '年以上' WHEN p_partkey % 4 = 2 THEN '应届' END AS years,
CAST(CASE WHEN p_partkey % 7 = 0 THEN 9000 WHEN p_partkey % 4 = 0 THEN 15000 WHEN p_partkey % 4 = 1 THEN 15000 END AS DOUBLE) AS low, CAST(CASE WHEN p_partkey % 7 = 0 THEN 11000 WHEN p_partkey % 4 = 0 THEN 30000 WHEN p_partkey % 4 = 1 THEN 20000 END AS DOUBLE) AS high,
CASE p_partkey % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'expert' WHEN 2 THEN 'junior' ELSE 'junior' END AS rank FROM part""")
def parsed_vacancies(spark, d):
    """Vacancies made of parts: every fifth has years stated, every seventh pay."""
    t = F.expr(_JD)
    low = lambda n, value: F.when(F.col("p_partkey") % n == 0, F.lit(value)).cast("long")
    p = table(spark, d, "part").select("p_partkey", t.alias("t"), low(5, 2).alias("y0"), low(5, 4).alias("y1"), low(7, 9).alias("s0"), low(7, 11).alias("s1"))
    pay = evaluate.pay_of(F.col("s0"), F.col("s1"), F.col("t"))
    return p.select("p_partkey", evaluate.education_of(F.lit(None).cast("string"), F.col("t")).alias("degree"), evaluate.experience_of(F.col("y0"), F.col("y1"), F.col("t")).alias("years"), pay["low"].cast("double").alias("low"), pay["high"].cast("double").alias("high"), evaluate.rank_of(F.col("t"), F.lit(None).cast("int")).alias("rank"))


@query()
def lexicon_mentions(spark, d):
    return evaluate.lexicon_skills(table(spark, d, "documents"), [(w, w) for w in PLAIN_WORDS])


@query("""WITH c AS (SELECT CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN 'Go' WHEN 2 THEN 'x' ELSE '  ' || replace(p_name, ' ', '   ') END AS raw, p_brand AS skill_id, p_partkey AS place FROM part),
k AS (SELECT trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS surface, skill_id, place FROM c) SELECT arg_min(surface, place) AS surface, lower(surface) AS surface_folded, arg_min(skill_id, place) AS skill_id FROM k WHERE length(surface) >= 2 AND lower(surface) <> 'go' GROUP BY lower(surface)""")
def claimed_aliases(spark, d):
    raw = F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).when(F.col("p_partkey") % 5 == 1, "Go").when(F.col("p_partkey") % 5 == 2, "x").otherwise(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit("   "))))
    c = table(spark, d, "part").select(raw.alias("surface"), F.col("p_brand").alias("skill_id"), F.lit("part").alias("source"), F.col("p_partkey").alias("place"))
    return evaluate.claimed_aliases(c).drop("source")


@query("""WITH c AS (SELECT p_brand AS skill_id, p_partkey AS place, 'https://x.org/' || (p_partkey % 50) AS url FROM part), u AS (SELECT skill_id, url, min(place) AS place FROM c GROUP BY ALL),
n AS (SELECT skill_id, CAST(row_number() OVER (PARTITION BY skill_id ORDER BY place, url) AS INT) AS place, url FROM u WHERE skill_id <> 'Brand#11' AND (skill_id <> 'Brand#12' OR url = 'https://x.org/12')) SELECT skill_id, place, url FROM n WHERE place <= 3 AND url <> 'https://x.org/7' UNION ALL SELECT 'Brand#11', 1, 'https://cached.org'""")
def attached_resources(spark, d):
    p = table(spark, d, "part")
    w = F.col("p_partkey")
    c = p.select(F.col("p_brand").alias("skill_id"), w.alias("place"), F.concat(F.lit("https://x.org/"), w % 50).alias("url")).groupBy("skill_id", "url").agg(F.min("place").alias("place")).withColumns({"title": F.lit("t"), "kind": F.lit("course")})
    cached = spark.createDataFrame([("Brand#11", 1, "https://cached.org", "t", "course")], "skill_id string, place int, url string, title string, kind string")
    picked = c.where("skill_id = 'Brand#12' and url = 'https://x.org/12'").select("skill_id", F.lit(1).alias("place"), "url").union(spark.createDataFrame([("Brand#12", 2, "https://made.up")], "skill_id string, place int, url string"))
    alive = c.select("url").where("url <> 'https://x.org/7'").union(cached.select("url"))
    return evaluate.attach_resources(p.select(F.col("p_brand").alias("skill_id")), c, cached, picked, alive).select("skill_id", "place", "url")


# Vocabularies


def _vocabulary(spark, d) -> tuple[DataFrame, DataFrame]:
    """Skills and aliases of parts: brands are their languages, every second name is an example."""
    p = table(spark, d, "part")
    slug = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    given = p.select(
        slug.alias("slug"), F.col("p_name").alias("name_zh"), F.initcap("p_name").alias("name_en"), F.array("p_type", F.concat("p_brand", F.lit(" "), "p_name")).alias("extra"),
        F.lit("").alias("parent"), F.col("p_brand").alias("cluster_id"), F.lit("x").alias("direction"), F.col("p_brand").alias("language"),
    )
    spoken = p.select(F.col("p_brand").alias("name"), F.lit(0).alias("place"), F.replace("p_brand", F.lit("#"), F.lit("  ")).alias("alias")).distinct()
    seen = vocabulary.examples_of(p.where("p_partkey % 2 = 0").select(F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "Y").otherwise("N").alias("hot_technology"), F.col("p_partkey").alias("place")))
    more = p.where("p_partkey % 7 = 0").select(slug.alias("slug"), F.lit(0).alias("place"), F.concat(F.lit("the "), "p_name").alias("alias"))
    return vocabulary.build_skills(given, spoken, seen, more, "1")


_CLAIMS = """WITH p AS (SELECT *, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS slug FROM part), e AS (SELECT DISTINCT upper(p_name) AS u FROM part WHERE p_partkey % 2 = 0),
w AS (SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS en FROM part),
c AS (SELECT slug, 0 AS step, p_name AS text, 'curated' AS source FROM p UNION ALL SELECT slug, 1, en, 'curated' FROM p JOIN w USING (p_partkey) UNION ALL SELECT slug, 2, p_type, 'curated' FROM p UNION ALL SELECT slug, 3, p_brand || ' ' || p_name, 'curated' FROM p
UNION ALL SELECT slug, 4, lower(p_name), 'curated' FROM p UNION ALL SELECT slug, 5, replace(p_brand, '#', '  '), 'linguist' FROM p UNION ALL SELECT slug, 6, u, 'onet' FROM p JOIN e ON upper(p_name) = u UNION ALL SELECT slug, 7, 'the ' || p_name, 'llm' FROM p WHERE p_partkey % 7 = 0),
k AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS surface, row_number() OVER (ORDER BY slug, step) AS place FROM c),
held AS (SELECT arg_min(surface, place) AS surface, lower(surface) AS surface_folded, 'skill.' || arg_min(slug, place) AS skill_id, arg_min(source, place) AS source FROM k WHERE length(surface) >= 2 GROUP BY lower(surface))"""


@query(f"{_CLAIMS} SELECT *, '1' AS ontology_version FROM held")
def built_aliases(spark, d):
    return _vocabulary(spark, d)[1]


@query(f"""{_CLAIMS}, own AS (SELECT skill_id, text, min(place) AS place, arg_min(k.source, place) AS source FROM k JOIN held ON lower(k.surface) = surface_folded AND 'skill.' || slug = skill_id JOIN p USING (slug) WHERE text <> p_name GROUP BY skill_id, text),
a AS (SELECT skill_id, string_agg(text, '|' ORDER BY place) AS aliases, max(source = 'llm') AS by_model FROM own GROUP BY skill_id)
SELECT 'skill.' || slug AS id, p_name AS name, p_brand AS cluster_id, coalesce(aliases, '') AS aliases, 'curated,linguist' || CASE WHEN u IS NOT NULL THEN ',onet' ELSE '' END || CASE WHEN by_model THEN ',llm' ELSE '' END AS sources FROM p LEFT JOIN a ON 'skill.' || slug = skill_id LEFT JOIN e ON upper(p_name) = u""")
def built_skills(spark, d):
    return _vocabulary(spark, d)[0].select("id", "name", "cluster_id", F.array_join("aliases", "|").alias("aliases"), F.array_join("sources", ",").alias("sources"))


@query("""SELECT 'c' || n AS id, 'group ' || n AS name, coalesce(string_agg('skill.' || p_partkey, ',' ORDER BY 'skill.' || p_partkey), '') AS skill_ids, '1' AS ontology_version FROM range(1, 8) r(n) LEFT JOIN part ON p_partkey % 7 = n GROUP BY n""")
def built_clusters(spark, d):
    of = F.concat(F.lit("c"), F.col("p_partkey") % 7)
    skills = table(spark, d, "part").select(F.concat(F.lit("skill."), "p_partkey").alias("id"), of.alias("cluster_id"))
    n = F.col("id").cast("string")
    given = spark.range(1, 8).select(F.concat(F.lit("c"), n).alias("id"), F.concat(F.lit("group "), n).alias("name"), n.alias("name_en"), F.lit("x").alias("direction"))
    return vocabulary.build_clusters(given, skills, "1").select("id", "name", F.array_join("skill_ids", ",").alias("skill_ids"), "ontology_version")


@query("""WITH r AS (SELECT CASE p_partkey % 5 WHEN 0 THEN 'major' WHEN 1 THEN 'mid' WHEN 2 THEN 'small' WHEN 3 THEN 'occupation' ELSE 'job_type' END AS level, p_partkey AS k, p_name,
CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey AS VARCHAR) WHEN 1 THEN '2-' || p_partkey WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN '2-02-10' ELSE '2-02-1' END || CASE WHEN p_partkey % 4 < 2 THEN '' ELSE '0' END ELSE '4-04-05-' || p_partkey END AS code FROM part)
SELECT 'occ.' || code AS id, code, CASE WHEN k % 5 < 3 THEN 'g' END AS gbm, CASE WHEN k % 5 = 3 AND k % 10 = 3 THEN 'fixed' ELSE p_name END AS name, level, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '2' WHEN 2 THEN '2-02' WHEN 3 THEN '4-04-05' ELSE 'own' END AS parent_code,
k % 5 = 3 AND k % 10 = 3 OR k % 5 >= 3 AND k % 2 = 0 AND NOT (k % 5 = 3 AND k % 10 = 3) AS is_digital, false AS is_green, k % 5 >= 3 OR code = '2-02-10' AS is_it_related, k % 5 = 2 AND code <> '2-02-10' AS is_placeholder, '1' AS ontology_version, 's' AS source FROM r""")
def occupation_catalogue(spark, d):
    k, p = F.col("p_partkey"), table(spark, d, "part")
    s, m = k.cast("string"), k % 5
    small = F.concat(F.when(k % 2 == 0, "2-02-10").otherwise("2-02-1"), F.when(k % 4 < 2, "").otherwise("0"))
    code = F.when(m == 0, s).when(m == 1, F.concat(F.lit("2-"), s)).when(m == 2, small).otherwise(F.concat(F.lit("4-04-05-"), s))
    level = F.when(m == 0, "major").when(m == 1, "mid").when(m == 2, "small").when(m == 3, "occupation").otherwise("job_type")
    rows = p.select(level.alias("level"), code.alias("code"), F.col("p_name").alias("name"), F.lit("g").alias("gbm"), F.lit("own").alias("parent_code"), (k % 2 == 0).alias("is_digital"), F.lit(False).alias("is_green"))
    fixes = p.where((m == 3) & (k % 10 == 3)).select(code.alias("code"), F.lit("fixed").alias("name"), F.lit(True).alias("is_digital"), F.lit(False).alias("is_green"))
    return vocabulary.occupation_rows(rows, fixes, "1", "s")


@query("""WITH r AS (SELECT CAST(p_size AS INT) AS batch, p_name AS name, CASE WHEN p_partkey % 4 = 0 THEN 'job_type' ELSE 'occupation' END AS kind FROM part)
SELECT DISTINCT 'newocc.' || CASE WHEN batch < 10 THEN '0' ELSE '' END || batch || CASE kind WHEN 'job_type' THEN '.job.' ELSE '.' END || name AS id, name, kind, batch, 'b' || batch AS batch_name, '1' AS ontology_version FROM r""")
def new_occupation_catalogue(spark, d):
    job, b = F.col("p_partkey") % 4 == 0, F.col("p_size").cast("int")
    batches = table(spark, d, "part").groupBy(b.alias("batch")).agg(F.collect_set(F.when(~job, F.col("p_name"))).alias("occupations"), F.collect_set(F.when(job, F.col("p_name"))).alias("job_types"))
    return vocabulary.new_occupation_rows(batches.withColumn("batch_name", F.concat(F.lit("b"), "batch")), "1")
