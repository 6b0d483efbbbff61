"""Queries on raw vacancies: mappers, salaries, necessity, sections; each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, vacancy
from ..operators import review
from ..sources import payloads
from ..sources.tables import table
from .profiles import BLOCKS, PLACES, benchmark_quotes

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Each part as a payload of the source that its key gives; `{...}` are SQL expressions of both engines.
TEMPLATES = {
    "mohrss": '{"md5":"{id}","acb22a":"{name}","aab004":"{maker}","area_":"","s_aae395":"1999-02-0{digit}T00:00","acb241":"{size}.7","acb242":"x"}',
    "moka": '{"org_name":"{maker}","job":{"id":{id},"title":"{name}","locations":[{"city":" {brand}"}],"openedAt":"1999-02-0{digit}","description":"<p>{name}</p>","minSalary":{size},"maxSalary":"1{size}00"}}',
    "greenhouse": '{"board_name":"{maker}","job":{"id":{id},"title":"{name}","location":{"name":"{brand}"},"updated_at":"1999-02-0{digit}","content":"&lt;b&gt;{name}&lt;/b&gt;"}}',
    "lever": '{"board_token":"{maker}","job":{"id":"{id}","text":"{name}","categories":{"location":"{brand}"},"createdAt":917827200000,"descriptionPlain":"{name}","salaryRange":{"min":{size},"max":1{size}}}}',
    "ashby": '{"board_name":"{maker}","job":{"id":"{id}","title":"{name}","location":"{brand}","publishedAt":"1999-02-0{digit}","descriptionHtml":"<i>{name}</i>","compensation":{"summaryComponents":[{"compensationType":"Equity","minValue":1},{"compensationType":"Salary","minValue":{size},"maxValue":1{size}}]}}}',
    "zhipin": '{"job":{"encryptJobId":"{id}","jobName":"{name}","brandName":"{maker}","cityName":"{brand}","lastModifyTime":917827200000,"postDescription":"{name}","salaryDesc":"{size}-1{size}K"}}',
    "jobhive_moka": '{"ats_id":"{id}","title":"{name}","company":"{maker}","location":"{brand}","posted_at":"1999-02-0{digit}","description":"{name}","salary_summary":"{size}万-1{size}万/年"}',
    "liepin": '{"title":"{name}","company":"{maker}","city":"{brand}","published_at":"1999-02-0{digit}","text":"{name}"}',
}
VALUES = {"id": "CAST(p_partkey AS STRING)", "name": "p_name", "maker": "p_type", "brand": "p_brand", "size": "CAST(p_size AS STRING)", "digit": "CAST(p_partkey % 9 + 1 AS STRING)"}
SOURCES = list(TEMPLATES)


def snapshots(spark, d) -> DataFrame:
    def filled(template: str) -> str:
        out = f"'{template}'"
        for name, value in VALUES.items():
            out = f"replace({out}, '{{{name}}}', {value})"
        return out

    p = table(spark, d, "part")
    payload = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {filled(t)}" for i, t in enumerate(TEMPLATES.values())) + " END"
    source = "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SOURCES)) + " END"
    s = p.select(F.expr(source).alias("source_id"), F.expr(payload).alias("payload"))
    return s.withColumn("content_hash", F.sha2("payload", 256)).withColumn("id", F.concat_ws(":", "source_id", "content_hash"))


_K = "p_partkey % 8"
MAPPED = f"""SELECT (['{"', '".join(SOURCES)}'])[CAST({_K} + 1 AS INT)] AS source_id, CASE WHEN {_K} < 7 THEN CAST(p_partkey AS VARCHAR) END AS native, p_name AS title, p_type AS company, CASE WHEN {_K} > 0 THEN p_brand END AS city,
  CASE WHEN {_K} = 2 THEN NULL WHEN {_K} IN (3, 5) THEN '1999-02-01' ELSE '1999-02-0' || (p_partkey % 9 + 1) END AS published_at, CASE WHEN {_K} = 2 THEN '1999-02-0' || (p_partkey % 9 + 1) END AS updated_at, CASE WHEN {_K} > 0 THEN p_name END AS description,
  CAST(CASE {_K} WHEN 2 THEN NULL WHEN 7 THEN NULL WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 5 THEN p_size * 1000 WHEN 6 THEN p_size * 10000 // 12 ELSE p_size END AS DOUBLE) AS salary_min,
  CAST(CASE WHEN {_K} IN (0, 2, 7) THEN NULL WHEN {_K} = 1 AND p_size = 0 THEN 100000 WHEN {_K} = 1 THEN ('1' || p_size || '00')::BIGINT * CASE WHEN ('1' || p_size || '00')::BIGINT < 1000 THEN 1000 ELSE 1 END WHEN {_K} = 5 THEN ('1' || p_size)::BIGINT * 1000 WHEN {_K} = 6 THEN ('1' || p_size)::BIGINT * 10000 // 12 ELSE ('1' || p_size)::BIGINT END AS DOUBLE) AS salary_max FROM part"""


@query(MAPPED)
def posting_mappers(spark, d):
    """Postings of every source's payloads; native is null where the id is the payload's hash."""
    p = payloads.to_postings(snapshots(spark, d))
    native = F.when(F.col("source_id") != "liepin", F.substring_index("posting_id", ":", -1)).alias("native")
    return p.select("source_id", native, "title", "company", "city", F.col("published_at").cast("string").alias("published_at"), F.col("updated_at").cast("string").alias("updated_at"), "description", F.col("salary_min").cast("double").alias("salary_min"), F.col("salary_max").cast("double").alias("salary_max"))


@query("SELECT p_partkey, CAST(p_size * f AS BIGINT) AS low, CAST((p_size + 5) * f AS BIGINT) AS high FROM (SELECT *, 1000 AS f FROM part)")
def salary_ranges(spark, d):
    s = vacancy.salary_range(F.concat(F.col("p_size").cast("string"), F.lit(" - "), (F.col("p_size") + 5).cast("string"), F.lit("k")))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.*")


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS price, CASE WHEN p_size % 2 = 1 THEN CAST(p_size AS DOUBLE) END AS odd_size FROM part")
def whole_numbers(spark, d):
    return table(spark, d, "part").select("p_partkey", vacancy.whole_number(F.col("p_retailprice")).alias("price"), vacancy.whole_number(F.when(F.col("p_size") % 2 == 1, F.concat(F.col("p_size").cast("string"), F.lit(".5"))).otherwise(F.col("p_name"))).cast("double").alias("odd_size"))


LAST = "list_last(string_split(coalesce(text, ''), '\n'))"
MARKS = ["license", "reserved", "token"], ["the", "las"]


def _last_sql(parts: list[str]) -> str:
    return "greatest(-1, " + ", ".join(f"CASE WHEN strpos(reverse(w), '{p[::-1]}') = 0 THEN -1 ELSE length(w) - strpos(reverse(w), '{p[::-1]}') + 1 - {len(p)} END" for p in parts) + ")"


@query(f"""WITH q AS (SELECT doc_id, coalesce(text, '') AS t, {LAST} AS q FROM documents), i AS (SELECT *, CASE WHEN q = '' THEN 0 ELSE greatest(strpos(t, q) - 1, 0) END AS a FROM q),
w AS (SELECT doc_id, substring(t, greatest(a - 160, 0) + 1, a - greatest(a - 160, 0) + length(q)) AS w FROM i)
SELECT doc_id, CASE WHEN {_last_sql(MARKS[0])} < 0 AND {_last_sql(MARKS[1])} < 0 THEN NULL WHEN {_last_sql(MARKS[1])} > {_last_sql(MARKS[0])} THEN 'bonus' ELSE 'required' END AS necessity FROM w""")
def necessity_of_last_lines(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", vacancy.necessity(F.element_at(F.split(t, "\n"), -1), t, *MARKS).alias("necessity"))


#: Headings that the provided documents have.
HEADINGS = {"license": r"all rights reserved\.|released under the MIT License\.", "work": r"of\.|the\.", "skill": r"thing\."}
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i)^\\s*[：:]*\\s*(?:{p})\\s*[：:]*\\s*$') THEN '{k}'" for k, p in HEADINGS.items()) + " END"


@query(rf"""WITH l AS (SELECT doc_id, length(coalesce(text, '')) AS size, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), e AS (SELECT doc_id, size, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM l),
k AS (SELECT doc_id, size, i, {_KIND} AS kind, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e),
m AS (SELECT *, count(kind) OVER (PARTITION BY doc_id) AS n FROM k QUALIFY kind IS NOT NULL OR i = 0)
SELECT doc_id, coalesce(kind, CASE WHEN n = 0 THEN 'full' ELSE 'basic' END) AS kind, CAST(start AS INT) AS start, CAST(coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY i), size) AS INT) AS "end" FROM m""")
def document_sections(spark, d):
    return vacancy.segments(table(spark, d, "documents"), HEADINGS)


@query(f"WITH {BLOCKS} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_blocks, CAST(sum(length(block)) AS BIGINT) AS chars FROM bl WHERE length(block) >= 8 GROUP BY 1")
def document_blocks(spark, d):
    return text.blocks(table(spark, d, "documents"), "source").groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("block")).cast("long").alias("chars"))


EVIDENCE = "e AS (SELECT DISTINCT l_orderkey AS claim_id, l_orderkey * 10 + l_linenumber AS evidence_id FROM lineitem)"
STATES = "CASE o_orderstatus WHEN 'F' THEN 'supported' WHEN 'O' THEN 'unsupported' ELSE o_orderstatus END"


def evidence(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id")).distinct()


@query(f"""WITH {EVIDENCE}, c AS (SELECT o_orderkey AS claim_id, {STATES} AS v, unnest([3, 1, 5]) AS line, unnest([1, 2, 3]) AS place FROM orders),
k AS (SELECT claim_id, string_agg(line::VARCHAR, ',' ORDER BY place) AS cited FROM c JOIN e ON e.claim_id = c.claim_id AND evidence_id = c.claim_id * 10 + line GROUP BY ALL)
SELECT o_orderkey AS claim_id, CASE WHEN {STATES} IN ('supported', 'unsupported', 'uncertain') THEN {STATES} ELSE 'uncertain' END AS verdict, coalesce(cited, '') AS cited FROM orders LEFT JOIN k ON claim_id = o_orderkey""".replace("SELECT claim_id, string_agg", "SELECT c.claim_id, string_agg"))
def review_verdicts(spark, d):
    """Each order as a claim that cites its lines 3, 1 and 5; the digits of the lines that it has are left."""
    k = F.col("o_orderkey")
    r = table(spark, d, "orders").select(k.alias("claim_id"), F.expr(STATES).alias("verdict"), F.array(k * 10 + 3, k * 10 + 1, k * 10 + 5).alias("cited"))
    v = review.verdicts(r, evidence(spark, d))
    return v.select("claim_id", "verdict", F.array_join(F.transform("cited", lambda x: (x % 10).cast("string")), ",").alias("cited"))


@query("SELECT o_orderkey AS claim_id, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN c_acctbal >= 0 THEN 'published' WHEN c_acctbal < 0 THEN 'rejected' ELSE 'unverified' END AS state FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def claim_decisions(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), "o_custkey", F.when(F.col("o_orderstatus") == "O", "unverified").otherwise(F.col("o_orderstatus")).alias("state"))
    accept = o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("claim_id", (F.col("c_acctbal") >= 0).alias("accept"))
    return review.decide(o.select("claim_id", "state"), accept)


@query(f"WITH {EVIDENCE} SELECT o_orderkey AS claim_id, CAST(place AS INT) AS place, evidence_id FROM (SELECT o_orderkey, unnest([3, 1, 5]) AS line, unnest([0, 1, 2]) AS place FROM orders) JOIN e ON evidence_id = o_orderkey * 10 + line")
def claim_provenance(spark, d):
    k = F.col("o_orderkey")
    return review.provenance(table(spark, d, "orders").select(k.alias("claim_id"), F.array(k * 10 + 3, k * 10 + 1, k * 10 + 5).alias("evidence_ids")), evidence(spark, d).select("evidence_id"))


@query("SELECT event_id AS change_id, event_type AS kind, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS rolled_back FROM events")
def change_log_rollback(spark, d):
    log = table(spark, d, "events").select(F.col("event_id").alias("change_id"), F.col("event_type").alias("kind"), F.lit(False).alias("rolled_back"), "user_id")
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return review.rolled_back(log, log.join(bad, "user_id", "left_semi")).select("change_id", "kind", "rolled_back")


@query(f"""WITH {PLACES}, p AS (SELECT doc_id, item_id, min(start) AS s, arg_min("end", start) AS e FROM f GROUP BY ALL), q AS (SELECT doc_id, item_id, s + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS s, e + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS e FROM p),
t AS (SELECT item_id, max((substring(d.text, s + 1, e - s) = b.text OR lower(substring(d.text, s + 1, e - s)) = lower(b.text))::INT) AS t, (count(DISTINCT source) >= 2)::INT AS m FROM q JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id) GROUP BY 1)
SELECT count(*) AS n_claims, avg(coalesce(t, 0)) AS traceable_rate, avg(coalesce(m, 0)) AS multi_source_rate FROM benchmark LEFT JOIN t USING (item_id)""")
def evidence_trace_rates(spark, d):
    """Each benchmark item as a claim, with its first places in documents as evidence; places of every third item are off by one."""
    docs, bench = table(spark, d, "documents"), benchmark_quotes(spark, d)
    places = text.pick_places(text.locate(docs, bench)).join(docs.select("doc_id", "source"), "doc_id").join(bench, "item_id")
    off = (F.col("item_id") % 3 == 0).cast("int")
    e = places.select(F.col("item_id").alias("claim_id"), "doc_id", F.col("source").alias("source_id"), (F.col("start") + off).alias("start"), (F.col("end") + off).alias("end"), "quote")
    return review.claim_rates(bench.select(F.col("item_id").alias("claim_id")), e, docs)


@query("""WITH j AS (SELECT unnest(['quality', 'toxic']) AS field, unnest([(length(text) >= 300)::INT = quality AND lang IS NOT NULL, (toxic = 0) AND lang IS NOT NULL]) AS hit FROM labels JOIN documents USING (doc_id))
SELECT coalesce(field, 'micro') AS field, count(*) AS n, avg(coalesce(hit, false)::INT) AS accuracy FROM j GROUP BY ROLLUP (field)""")
def field_accuracy(spark, d):
    """Predictions of labels by length, for documents with a language only; a document without has none and counts as wrong."""
    docs = table(spark, d, "documents")
    gold = table(spark, d, "labels").join(docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", "toxic")
    pred = docs.where("lang is not null").select("doc_id", (F.length("text") >= 300).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return review.field_accuracy(gold, pred, "doc_id", ["quality", "toxic"])


@query("""WITH c AS (SELECT DISTINCT p_brand AS src, p_type AS dst FROM part), m AS (SELECT src, dst, length(dst) % 2 = 0 AS active FROM c WHERE src < 'Brand#3')
SELECT src, dst, CASE WHEN active IS NULL THEN 'asymmetry' ELSE 'manual' END AS rule, CASE WHEN active IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS confidence, coalesce(active, true) AS active, active IS NOT NULL AS locked FROM c LEFT JOIN m USING (src, dst)""")
def prereq_overrides(spark, d):
    c = table(spark, d, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).distinct()
    manual = c.where("src < 'Brand#3'").withColumn("active", F.length("dst") % 2 == 0)
    return review.with_overrides(c.withColumns({"rule": F.lit("asymmetry"), "confidence": F.lit(0.5)}), manual)


@query("""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[:80] AS ls FROM documents)
SELECT doc_id, CAST(i AS INT) AS line, text, least(0.96, 0.04 + i * 0.035)::DOUBLE AS y FROM (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS i FROM l)""")
def evidence_lines(spark, d):
    return review.text_lines(table(spark, d, "documents"))
