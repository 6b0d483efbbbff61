"""Queries on stored responses of boards, collecting from them as a stream, and sinks; each with SQL that gives the same rows.

Responses are made of the provided tables, some vacancies a page, and written to the shared folder, as a fetcher would leave them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sql as functions
from ..operators import store
from ..sources import responses
from ..sources.shared import shared_folder
from ..sources.tables import SQL_BASE, sql_obs, table
from ..streaming import collect
from .evolution import obs
from .profiles import _BARE, DRESSED, PLAIN_WORDS, mention_counts
from .profiles import SQL as PROFILES_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def pages(rows: DataFrame, page: Column, job: Column, asked: Column, before: str = "[", after: str = "]", status: Column | None = None, wrap=None) -> DataFrame:
    """A response for each page of rows (key, ...): its vacancies in the order of their keys."""
    each = rows.select("key", page.alias("seq"), job.alias("job"), asked.alias("asked"))
    jobs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "job"))), lambda x: x["job"]), "," if before.endswith("[") else "")
    p = each.groupBy("seq").agg(F.first("asked").alias("asked"), jobs.alias("jobs"))
    body = F.concat(F.lit(before), wrap(F.col("jobs")) if wrap else F.col("jobs"), F.lit(after))
    ok = F.lit(200) if status is None else status
    return p.select("seq", F.concat(F.lit("u/"), F.col("seq").cast("string")).alias("url"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("fetched_at"), ok.alias("status"), "asked", body.alias("body"))


def stored(spark, rows: DataFrame, board: str, **how) -> DataFrame:
    path = responses.write(rows, shared_folder(spark))
    return responses.stored(spark, board, path, **how).drop("fetched_at")


def _snapshots(board: str, url: str, payload: str, rows: str) -> str:
    return f"SELECT '{board}:' || sha256(x) AS id, '{board}' AS source_id, url, sha256(x) AS content_hash, x AS payload FROM (SELECT {url} AS url, {payload} AS x FROM {rows})"


def _token() -> Column:
    return F.struct(F.concat(F.lit("t"), (F.col("page") % 7).cast("string")).alias("token"), F.concat(F.lit("Board "), (F.col("page") % 7).cast("string")).alias("name"))


_BOARD = """'{"board_name":"Board ' || page % 7 || '","board_token":"t' || page % 7 || '","job":'"""


@query(_snapshots("greenhouse", "CASE WHEN p_partkey % 3 = 0 THEN 'u/' || page ELSE 'g/' || p_partkey END", _BOARD + """ || '{' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '"absolute_url":"g/' || p_partkey || '",' END || '"id":' || p_partkey || ',"title":"' || p_name || '","updated_at":"1999-02-0' || (p_partkey % 9 + 1) || '"}}'""", "(SELECT *, p_partkey // 40 AS page FROM part) WHERE p_partkey % 9 + 1 >= 4"))
def greenhouse_stored(spark, d):
    key = F.col("p_partkey")
    job = F.to_json(F.struct(F.when(key % 3 != 0, F.concat(F.lit("g/"), key.cast("string"))).alias("absolute_url"), key.alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("1999-02-0"), (key % 9 + 1).cast("string")).alias("updated_at"), F.lit("x").alias("jobManager")))
    rows = table(spark, d, "part").withColumns({"key": key, "page": F.floor(key / 40)})
    return stored(spark, pages(rows, F.col("page"), job, _token(), '{"jobs":[', "]}"), "greenhouse", since="1999-02-04")


@query(_snapshots("lever", "'l/' || event_id", _BOARD + """ || '{"createdAt":' || epoch_us(ts) // 1000 || ',"hostedUrl":"l/' || event_id || '","id":' || event_id || ',"text":"' || event_type || '"}}'""", "(SELECT *, event_id // 100 AS page FROM events) WHERE CAST(ts AS DATE) >= (SELECT CAST(max(ts) AS DATE) - 10 FROM events)"))
def lever_stored(spark, d):
    e = table(spark, d, "events")
    since = e.agg((F.date_sub(F.to_date(F.max("ts")), 10)).cast("string")).first()[0]
    job = F.to_json(F.struct(F.unix_millis("ts").alias("createdAt"), F.concat(F.lit("l/"), F.col("event_id").cast("string")).alias("hostedUrl"), F.col("event_id").alias("id"), F.col("event_type").alias("text")))
    rows = e.withColumns({"ts": F.col("ts").cast("timestamp"), "key": F.col("event_id"), "page": F.floor(F.col("event_id") / 100)})
    return stored(spark, pages(rows, F.col("page"), job, _token()), "lever", since=since)


@query(_snapshots("ashby", "'a/' || o_orderkey", _BOARD + """ || '{"id":' || o_orderkey || ',"jobUrl":"a/' || o_orderkey || '"' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',"publishedAt":"' || strftime(o_orderdate, '%Y-%m-%d') || 'T08:00"' END || ',"title":"' || o_orderpriority || '"}}'""", "(SELECT *, o_orderkey // 200 AS page FROM orders) WHERE o_orderkey % 5 = 0 OR o_orderdate >= TIMESTAMP '1997-01-01'"))
def ashby_stored(spark, d):
    key = F.col("o_orderkey")
    day = F.when(key % 5 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T08:00")))
    job = F.to_json(F.struct(key.alias("id"), F.concat(F.lit("a/"), key.cast("string")).alias("jobUrl"), day.alias("publishedAt"), F.col("o_orderpriority").alias("title")))
    rows = table(spark, d, "orders").withColumns({"key": key, "page": F.floor(key / 200)})
    return stored(spark, pages(rows, F.col("page"), job, _token(), '{"jobs":[', "]}"), "ashby", since="1997-01-01")


@query(_snapshots("mohrss", "'u/' || c_custkey // 30", """'{"acb22a":"' || c_name || '","md5":"' || c_custkey || '","s_aae395":"2024-0' || (c_custkey % 9 + 1) || '-01"' || CASE WHEN c_custkey % 4 = 0 THEN ',"s_aae397":"2024-09-02"' ELSE '' END || '}'""", "customer WHERE c_custkey % 4 = 0 OR c_custkey % 9 >= 4"))
def mohrss_stored(spark, d):
    """Lists in hidden inputs; the day is that of the update, or else that of publishing."""
    key = F.col("c_custkey")
    job = F.to_json(F.struct(F.col("c_name").alias("acb22a"), key.cast("string").alias("md5"), F.concat(F.lit("2024-0"), (key % 9 + 1).cast("string"), F.lit("-01")).alias("s_aae395"), F.when(key % 4 == 0, "2024-09-02").alias("s_aae397"), F.lit("someone").alias("aae004")))
    rows = table(spark, d, "customer").withColumn("key", key)
    quoted = lambda jobs: F.replace(F.concat(F.lit("["), jobs, F.lit("]")), F.lit('"'), F.lit("&quot;"))
    p = pages(rows, F.floor(key / 30), job, F.struct(F.floor(key / 30).alias("page_no")), "[", "]")
    p = p.withColumn("body", F.concat(F.lit('<p><input id="findjoblist" value="'), quoted(F.expr("substring(body, 2, length(body) - 2)")), F.lit('"></p>')))
    return stored(spark, p, "mohrss", since="2024-05-01")


@query(_snapshots("liepin", "'/zhaopin/' || p_partkey", """'{"href":"/zhaopin/' || p_partkey || '","text":"' || p_name || '"}'""", "part WHERE p_partkey // 20 < 6"))
def liepin_stored(spark, d):
    """Cards of pages, up to the seventh, which asks for a proof of being human."""
    key = F.col("p_partkey")
    job = F.concat(F.lit('<div><a href="/zhaopin/'), key.cast("string"), F.lit('"><b>'), F.replace("p_name", F.lit(" "), F.lit("</b> <i>")), F.lit("</a></div>"))
    p = pages(table(spark, d, "part").withColumn("key", key), F.floor(key / 20), job, F.struct(F.lit("x").alias("page_no")), "<html>", "</html>")
    return stored(spark, p.withColumn("body", F.when(F.col("seq") == 6, F.concat(F.lit("<p>geetest</p>"), "body")).otherwise(F.col("body"))), "liepin")


@query(_snapshots("zhipin", "'u/' || c_custkey // 50", """'{"city":"c","city_code":"' || c_custkey // 50 % 3 || '","job":{' || CASE WHEN c_custkey % 3 = 0 THEN '"description":"D' || c_custkey || '",' ELSE '' END || '"encryptJobId":"' || c_custkey || '","jobName":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN ',"postDescription":"D' || c_custkey || '"' ELSE '' END || ',"salaryDesc":"1-2K"},"keyword":"k"}'""", "customer WHERE c_custkey // 50 < 20"))
def zhipin_stored(spark, d):
    """Lists with details of every third vacancy, up to the first list whose code says no; pages are asked for in an order of their own."""
    key, page = F.col("c_custkey"), F.floor(F.col("c_custkey") / 50)
    job = F.to_json(F.struct(key.cast("string").alias("encryptJobId"), F.col("c_name").alias("jobName"), F.lit("1-2K").alias("salaryDesc"), F.lit("B").alias("bossName")))
    rows = table(spark, d, "customer").withColumn("key", key)
    asked = F.struct(F.lit("k").alias("keyword"), F.lit("c").alias("city"), (page % 3).cast("string").alias("city_code"))
    p = pages(rows, page, job, asked, '{"code":0,"zpData":{"jobList":[', "]}}")
    p = p.withColumn("body", F.when(F.col("seq") >= 20, F.replace("body", F.lit('"code":0'), F.lit('"code":37'))).otherwise(F.col("body")))
    detail = F.concat(F.lit('{"zpData":{"jobInfo":{"postDescription":"D'), key.cast("string"), F.lit('","address":""}}}'))
    details = rows.where(key % 3 == 0).select(key.alias("seq"), F.lit("v").alias("url"), F.lit(None).cast("timestamp").alias("fetched_at"), F.lit(200).alias("status"), F.struct(key.cast("string").alias("job_id")).alias("asked"), detail.alias("body"))
    return stored(spark, p, "zhipin", details=responses.write(details, shared_folder(spark)))


@query("""WITH j AS (SELECT p_brand, p_partkey, p_partkey % 2 AS mode, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey % 2, p_partkey) AS n FROM part), m AS (SELECT *, CASE mode WHEN 0 THEN 'social' ELSE 'campus' END AS m FROM j WHERE n <= 5)
""" + _snapshots("moka", "'u/' || p_partkey || '?mode=' || m", """'{"job":{"id":' || p_partkey || '},"mode":"' || m || '","org_id":"' || p_brand || '","org_name":"' || lower(p_brand) || '"}'""", "m"))
def moka_stored(spark, d):
    """The first five vacancies of each organisation, of mode social before campus."""
    key, mode = F.col("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "social").otherwise("campus")
    asked = F.struct(F.col("p_brand").alias("org_id"), F.lower("p_brand").alias("org_name"), mode.alias("mode"), key.alias("offset"))
    p = pages(table(spark, d, "part").withColumn("key", key), key, F.to_json(F.struct(key.alias("id"))), asked, '{"jobs":[', "]}")
    return stored(spark, p, "moka", per_org=5)


@query(_snapshots("jobhive_moka", "'s/' || s_suppkey", """'{"ats_type":"moka","posted_at":' || CASE WHEN s_suppkey % 6 = 0 THEN '"soon"' ELSE '"2024-01-0' || (s_suppkey % 9 + 1) || 'T00:00:00"' END || ',"salary_min":' || CASE WHEN s_suppkey % 10 = 0 THEN 'null' ELSE s_suppkey::VARCHAR END || ',"url":"s/' || s_suppkey || '"}'""", "supplier WHERE s_suppkey % 2 = 0 AND (s_suppkey % 6 = 0 OR s_suppkey % 9 >= 3)"))
def jobhive_stored(spark, d):
    """A slice with rows of two boards, days that can't be read and numbers that aren't."""
    key = F.col("s_suppkey")
    day = F.when(key % 6 == 0, "soon").otherwise(F.concat(F.lit("2024-01-0"), (key % 9 + 1).cast("string"), F.lit("T00:00:00")))
    row = F.concat(F.lit('{"ats_type": "'), F.when(key % 2 == 0, "moka").otherwise("beisen"), F.lit('", "posted_at": "'), day, F.lit('", "salary_min": '), F.when(key % 10 == 0, "NaN").otherwise(key.cast("string")), F.lit(', "bossName": "B", "url": "s/'), key.cast("string"), F.lit('"}'))
    path = shared_folder(spark)
    table(spark, d, "supplier").select(row.alias("value")).write.text(path)
    return responses.stored(spark, "jobhive_moka", path, since="2024-01-04").drop("fetched_at")


# Collecting as a stream


def _stored_parts(spark, d, files: int) -> str:
    """Pages of parts as greenhouse's responses; every tenth part is listed by two pages."""
    key = F.col("p_partkey")
    job = F.to_json(F.struct(key.alias("id"), F.col("p_name").alias("title"), F.lit("2024-03-05").alias("updated_at"), F.lit("x").alias("jobManager")))
    rows = table(spark, d, "part").withColumns({"key": key, "page": F.floor(key / 40)})
    every = rows.select("key", "p_partkey", "p_name", "page").unionByName(rows.where(key % 10 == 0).select("key", "p_partkey", "p_name", (F.col("page") + 1_000_000).alias("page")))
    token = F.struct(F.lit("t").alias("token"), F.lit("T").alias("name"))
    return responses.write(pages(every, F.col("page"), job, token, '{"jobs":[', "]}"), shared_folder(spark), files)


@query("""SELECT 'greenhouse:' || sha256(x) AS id, x AS payload, 5 AS flushes FROM (SELECT '{"board_name":"T","board_token":"t","job":{"id":' || p_partkey || ',"title":"' || p_name || '","updated_at":"2024-03-05"}}' AS x FROM part)""")
def collected_snapshots(spark, d):
    """Five files, a flush each; the run ends after two of them and is started again."""
    source, to = _stored_parts(spark, d, 5), collect.Store(spark, shared_folder(spark))
    if collect.collect(spark, "greenhouse", source, to, today="2024-04-01", peers=False, flushes=2) != "interrupted":
        raise RuntimeError("the run was to end")
    collect.collect(spark, "greenhouse", source, to, today="2024-04-01", peers=False)
    n = to.ledger().count()
    return to.snapshots().select("id", "payload", F.lit(n).cast("int").alias("flushes"))


@query("""SELECT 'greenhouse:' || p_partkey AS posting_id, p_name AS title, 'T' AS company, '2024-03-05' AS updated_at, '2024Q1' AS period FROM part""")
def collected_postings(spark, d):
    """Postings of a run by two files a flush; parts that two pages list are one."""
    to = collect.Store(spark, shared_folder(spark))
    collect.collect(spark, "greenhouse", _stored_parts(spark, d, 4), to, files=2, today="2024-04-01", peers=False)
    return to.postings().select("posting_id", "title", "company", F.col("updated_at").cast("string").alias("updated_at"), "period")


@query("SELECT '/zhaopin/' || p_partkey AS url, p_name AS text, 'halted' AS state FROM part WHERE p_partkey // 20 < 6")
def collected_until_halt(spark, d):
    """Cards of pages in one flush; the board objects to the seventh."""
    key = F.col("p_partkey")
    job = F.concat(F.lit('<a href="/zhaopin/'), key.cast("string"), F.lit('">'), F.col("p_name"), F.lit("</a>"))
    p = pages(table(spark, d, "part").withColumn("key", key), F.floor(key / 20), job, F.struct(F.lit("x").alias("page_no")), "<html>", "</html>")
    p = p.withColumn("status", F.when(F.col("seq") == 6, 403).otherwise(200))
    to = collect.Store(spark, shared_folder(spark))
    state = collect.collect(spark, "liepin", responses.write(p, shared_folder(spark), 3), to, files=3, today="2024-04-01", peers=False)
    return to.snapshots().select("url", F.get_json_object("payload", "$.text").alias("text"), F.lit(state).alias("state"))


# Sinks


def _store(spark) -> str:
    """A new store; its database's name."""
    root = shared_folder(spark)
    db = "graph_" + root.rsplit("-", 1)[-1]
    store.migrate(spark, root, db)
    return db


_OBS = f"WITH {SQL_BASE}, {sql_obs('o', 'role_id', 'md')}"


def _observed(spark, d) -> DataFrame:
    return obs(spark, d, ["role_id"]).withColumn("ontology_version", F.lit("0.1"))


@query(_OBS + """ SELECT role_id, skill_id, period, CASE WHEN period = '1995Q1' THEN weight / 2 ELSE weight END AS weight, posting_count + CASE WHEN period = '1995Q1' THEN 1 ELSE 0 END AS posting_count, total_postings FROM o
UNION ALL SELECT NULL, 'new', '1995Q1', 1.0, 1, 1""")
def observation_partitions(spark, d):
    """Observations stored by version and quarter; one quarter comes again, corrected, with a row for all roles."""
    db = _store(spark)
    rows = _observed(spark, d)
    store.put_observations(spark, db, rows)
    again = rows.where("period = '1995Q1'").withColumns({"weight": F.col("weight") / 2, "posting_count": F.col("posting_count") + 1})
    extra = spark.createDataFrame([(None, "new", "1995Q1", 1.0, 1, 1, "0.1")], "role_id string, skill_id string, period string, weight double, posting_count long, total_postings long, ontology_version string")
    store.put_observations(spark, db, again.unionByName(extra))
    return spark.table(f"{db}.observation").drop("ontology_version")


@query(_OBS + """ SELECT a.role_id, a.skill_id, a.weight AS before, b.weight AS after, n.state, s.ontology_version FROM (SELECT * FROM o WHERE period = '1995Q1') a JOIN (SELECT * FROM o WHERE period = '1995Q2') b USING (role_id, skill_id)
JOIN (SELECT DISTINCT role_id, CASE WHEN role_id = 'BUILDING' THEN 'proposed' ELSE 'published' END AS state FROM o) n USING (role_id), (SELECT '0.1' AS ontology_version) s""")
def graph_partitions(spark, d):
    """Edges by version and quarter, bucketed by role; two quarters join on role and skill without a shuffle, nodes have been made."""
    db = _store(spark)
    rows = _observed(spark, d)
    roles = spark.createDataFrame([("BUILDING", "Building", "proposed")], "role_id string, name string, state string")
    store.put_graph(spark, db, rows.where("period like '1995%'"), roles)
    store.put_graph(spark, db, rows.where("period = '1995Q2'").withColumn("ontology_version", F.lit("0.2")))
    a, b = (store.slice_edges(spark, db, "0.1", p).withColumnRenamed("weight", n) for p, n in (("1995Q1", "before"), ("1995Q2", "after")))
    skills = spark.table(f"{db}.skill").select("skill_id", "ontology_version")
    return a.join(b, ["role_id", "skill_id"]).join(spark.table(f"{db}.role").select("role_id", "state"), "role_id").join(skills, "skill_id")


@query("SELECT 'ev.' || event_id // 2 AS evidence_id, event_type AS source_id, user_id::VARCHAR AS posting_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id // 2 ORDER BY user_id::VARCHAR, event_type) = 1")
def evidence_sink(spark, d):
    """Evidence that is inserted once: rows whose id is there are left, of several the smallest comes."""
    db = _store(spark)
    e = table(spark, d, "events").withColumn("evidence_id", F.concat(F.lit("ev."), F.floor(F.col("event_id") / 2).cast("string")))
    rows = e.select("evidence_id", F.col("event_type").alias("source_id"), F.col("user_id").cast("string").alias("posting_id"), F.lit("s").alias("skill_id"), F.lit(0).alias("span_start"), F.lit(1).alias("span_end"), F.lit("q").alias("quote"), F.lit("x").alias("extractor"), F.lit(0.9).alias("confidence"))
    store.put_new(spark, f"{db}.evidence", rows, ["evidence_id"])
    store.put_new(spark, f"{db}.evidence", rows.withColumn("quote", F.lit("again")), ["evidence_id"])
    return spark.table(f"{db}.evidence").where("quote = 'q'").select("evidence_id", "source_id", "posting_id")


@query("SELECT unnest([1, 2]) AS version, unnest([0, 0]) AS applied_again, (SELECT count(*) FROM region) AS n_kept")
def schema_versions(spark, d):
    """A store that is brought to its first version, filled, brought to the last one, and once more."""
    root = shared_folder(spark)
    db = "graph_" + root.rsplit("-", 1)[-1]
    store.migrate(spark, root, db, upto=1)
    table(spark, d, "region").select(F.col("r_name").alias("role_id"), F.col("r_name").alias("name"), F.lit("published").alias("state")).write.insertInto(f"{db}.role")
    store.migrate(spark, root, db)
    again = len(store.migrate(spark, root, db))
    n = spark.table(f"{db}.role").count()
    return spark.table(f"{db}.{store.LEDGER}").select("version", F.lit(again).alias("applied_again"), F.lit(n).cast("long").alias("n_kept"))


# Functions in SQL


@query(PROFILES_SQL[mention_counts.__name__])
def mention_counts_in_sql(spark, d):
    functions.register(spark, {w: w for w in PLAIN_WORDS})
    table(spark, d, "documents").createOrReplaceTempView("tempograph_documents")
    return spark.sql("SELECT doc_id, s.surface, true AS here, count(*) AS n FROM tempograph_documents, LATERAL scan_skills(text) s GROUP BY doc_id, s.surface")


@query(f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '急聘java' || {_BARE} || '开发' WHEN 1 THEN {_BARE} || 'senior' WHEN 2 THEN {_BARE} || '工程师' ELSE {_BARE} || '产品经理专员' END AS title_key, p_name || chr(10) || '& more' AS page, 200.0 * length(p_name) / (2 * length(p_name) + 4) AS alike FROM part")
def functions_in_sql(spark, d):
    functions.register(spark)
    table(spark, d, "part").createOrReplaceTempView("tempograph_part")
    return spark.sql(f"""SELECT p_partkey, normalize_title({DRESSED}) AS title_key, html_text(concat('<script>x</script><p>', p_name, '</p><b>&amp; more</b>')) AS page, indel_ratio(p_name, concat(p_name, '####')) AS alike FROM tempograph_part""")
