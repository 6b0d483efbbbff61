"""Boards, ingest, extraction and layout on worked examples and against plain versions."""

import datetime
import json
import time

from pyspark.sql import functions as F

from tempograph.functions import text
from tempograph.operators import evaluate, extract, graph, ingest, pages
from tempograph.sources import boards
from tempograph.streaming import arrivals

from .test_kernels import duplicates_by_force

AT = "2024-01-01 00:00:00"


def pages_of(spark, rows, names):
    return spark.createDataFrame([(*r, "u", AT) for r in rows], f"{names}, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def test_payloads_are_canonical():
    a = boards._canonical('{"b": [{"bossName": 1, "é": "x"}], "a": null, "aae004": {"k": 1}}')
    assert a == '{"a":null,"b":[{"é":"x"}]}' and boards._canonical("[1]") is None and boards._canonical("no") is None and boards._canonical(None) is None


def test_lists_in_hidden_inputs(spark):
    items = [{"md5": "1", "s_aae397": "2024-02-01", "aae004": "me"}, {"md5": "2", "s_aae397": "bad", "s_aae395": "2023-01-01"}, {"md5": "3"}, "x"]
    value = json.dumps(items).replace('"', "&quot;")
    rows = [(1, f"<html><input type='text'><INPUT value=\"{value}\" id='findjoblist'></html>"), (2, "<input id='findjoblist'>"), (3, None), (4, "<p>none</p>")]
    got = [json.loads(r.payload) for r in boards.mohrss(pages_of(spark, rows, "page_no int, body string"), "2024-01-01").collect()]
    assert sorted(x["md5"] for x in got) == ["1", "3"] and all("aae004" not in x for x in got)


def test_cards_until_a_page_objects(spark):
    card = "<div class='a job-card'><b>T</b> <i>x\n y</i></div><a href='/zhaopin/1'>one<br>two</a><a href='/zhaopin/2?x'>no</a><a href='/other'>no</a><span data-job-id='7'></span>"
    rows = [(1, 200, card), (2, 200, "<p>请完成验证码</p>" + card), (3, 200, card)]
    got = boards.liepin(pages_of(spark, rows, "page_no int, status int, body string")).collect()
    assert sorted((json.loads(r.payload)["text"], r.url) for r in got) == [("T x y", "u"), ("one two", "/zhaopin/1")]


def test_lists_and_details_are_merged(spark):
    body = lambda *jobs, code=0: json.dumps({"code": code, "zpData": {"jobList": list(jobs)}})
    rows = [("k", "c", "1", 1, 200, body({"encryptJobId": "a", "jobName": "N", "salaryDesc": "1-2K", "bossName": "B", "other": 1}, {"encryptJobId": "b", "salaryDesc": ""})), ("k", "c", "1", 2, 200, body({"encryptJobId": "c"}, code=37)), ("k", "c", "1", 3, 200, body({"encryptJobId": "d"}))]
    lists = pages_of(spark, rows, "keyword string, city string, city_code string, page int, status int, body string")
    details = spark.createDataFrame([("a", json.dumps({"zpData": {"jobInfo": {"postDescription": "D", "address": ""}}}))], "job_id string, body string")
    got = {json.loads(r.payload)["job"]["encryptJobId"]: json.loads(r.payload) for r in boards.zhipin(lists, details).collect()}
    assert set(got) == {"a", "b"} and got["a"]["job"] == {"encryptJobId": "a", "jobName": "N", "salaryDesc": "1-2K", "postDescription": "D", "description": "D"} and got["b"]["job"] == {"encryptJobId": "b"} and got["a"]["city_code"] == "1"
    hidden = pages_of(spark, [("k", "c", "1", 1, 200, body({"encryptJobId": "a", "salaryDesc": " "}))], "keyword string, city string, city_code string, page int, status int, body string")
    assert boards.zhipin(hidden).count() == 0


def test_boards_with_dates_and_limits(spark):
    lever = pages_of(spark, [("t", "T", json.dumps([{"id": 1, "createdAt": 1709596800000, "hostedUrl": "h"}, {"id": 2, "createdAt": 1}, {"id": 3}, 5]))], "token string, name string, body string")
    assert sorted(json.loads(r.payload)["job"]["id"] for r in boards.lever(lever, "2024-01-01").collect()) == [1, 3]
    ashby = pages_of(spark, [("t", "T", json.dumps({"jobs": [{"id": i, "publishedAt": "2024-01-0%d" % i} for i in (1, 2, 3)]}))], "token string, name string, body string")
    assert sorted(json.loads(r.payload)["job"]["id"] for r in boards.ashby(ashby, "2024-01-02", most=1).collect()) == [2]
    hive = spark.createDataFrame([("moka", "u1", "2024-01-02", float("nan")), ("beisen", "u2", "2024-01-02", 1.0), ("moka", "u3", "2020-01-02", 1.0), ("moka", "u4", "soon", 2.0)], "ats_type string, url string, posted_at string, salary_min double")
    got = {r.url: json.loads(r.payload) for r in boards.jobhive(hive, "moka", "2023-01-01").collect()}
    assert set(got) == {"u1", "u4"} and got["u1"]["salary_min"] is None


def snapshots(spark, n=60):
    titles = ["Java开发工程师", "java 研发", "Senior Data Analyst of Things", "Senior Data Analyst of Thing", "销售", ""]
    rows = []
    for i in range(n):
        payload = {"title": titles[i % 6], "company": "ab"[i % 2], "city": "x" if i % 7 else "", "published_at": str(datetime.date(2024, 1, 1) + datetime.timedelta(days=i * 5 % 200)), "text": f"五险一金。共同的一段很长的文字在这里。编号{i}"}
        rows.append((f"s{i:03d}", "liepin", f"{i:032d}" + "0" * 8, json.dumps(payload), AT))
    return spark.createDataFrame(rows, "id string, source_id string, content_hash string, payload string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp")), rows


def test_postings_have_duplicates_and_boilerplate(spark):
    s, rows = snapshots(spark)
    got = {r.snapshot_id: r for r in ingest.to_postings(s).collect()}
    plain = [(i, datetime.date.fromisoformat(p["published_at"]), p["company"], p["city"], p["title"]) for i, _, _, x, _ in rows for p in [json.loads(x)]]
    # An empty title is told as the first characters of the text, so these rows are left out of the comparison.
    want = {k: v for k, v in duplicates_by_force([p[:4] + (got[p[0]].title,) for p in plain]).items()}
    of = {r.posting_id: k for k, r in got.items()}
    assert {k: of.get(r.duplicate_of) for k, r in got.items()} == want and sum(v is not None for v in want.values()) > 10
    assert all([r.description[x["start"] : x["end"]] for x in r.boilerplate_spans] == ["五险一金", "共同的一段很长的文字在这里。"] for r in got.values())
    assert got["s000"].period == "2024Q1" and got["s000"].title_normalized == "java开发"
    old = ingest.to_postings(s.where("id < 's030'"))
    new = ingest.to_postings(s.where("id >= 's030'"), old, peers=False)
    both = {r.snapshot_id: of.get(r.duplicate_of) for r in old.unionByName(new).collect()}
    assert both == want and new.select("boilerplate_spans").first()[0][0]["end"] == 4


def test_collecting_twice_saves_once(spark):
    s, _ = snapshots(spark, 20)
    none, empty = s.limit(0), ingest.to_postings(s.limit(0))
    kept, made, report = ingest.collect({"a": s.where("id < 's010'"), "b": s}, none, empty, "2024-03-01")
    assert [(r.source_id, r.saved, r.postings) for r in report.orderBy("source_id").collect()] == [("a", 10, 10), ("b", 10, 20)] and kept.count() == made.count() == 20
    again, made, report = ingest.collect({"a": s}, kept, made, "2024-03-01", most=5)
    assert report.first().saved == 0 and again.count() == made.count() == 20
    few, _, report = ingest.collect({"a": s, "b": s}, none, empty, "2024-03-01", most=5)
    assert few.count() == 5 and report.count() == 1


def test_pipeline_from_snapshots_to_graph(spark):
    s, _ = snapshots(spark, 12)
    vocabulary = spark.createDataFrame([("k.text", "文字", ["文字"]), ("k.no", "Rust", ["Rust", "rs"])], "id string, name string, surfaces array<string>")
    got = ingest.run_pipeline(s, ingest.to_postings(s.limit(0)), vocabulary, "2026Q3", "0.1")
    n = got["postings"].where("duplicate_of is null and description <> ''").count()
    assert got["evidence"].count() == n and got["skill"].collect()[0].name == "文字" and {r.weight for r in got["observations"].collect()} == {1.0}
    r = got["evidence"].first()
    assert r.quote == "文字" and r.evidence_id == f"ev.{r.posting_id}.k.text.{r.span_start}"


def test_replies_and_ratios(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("[1]",), ("no",), (None,), ('{"b": 2}',)], "c string")
    assert [r[0] for r in df.select(extract.reply_object("c")).collect()] == ['{"a": 1}', None, None, None, '{"b": 2}']
    assert extract.token_set("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and extract.token_set("", "a") == 0 and abs(extract.token_set("new york mets", "york yankees") - text.indel("york mets new", "york yankees")) < 20
    assert extract.token_set("react js", "react native") == max(text.indel("react js", "react native"), text.indel("react", "react js"), text.indel("react", "react native"))


def test_claims_keep_what_the_text_says(spark):
    t = "任职要求：熟悉Java开发。加分项：了解Go语言。五险一金"
    reply = {"competencies": [{"statement": "能写", "quote": "熟悉Java开发", "necessity": "bonus"}, {"statement": "假", "quote": "不存在"}], "skills": [{"surface_form": "Go", "quote": "了解 Go语言", "necessity": "required"}, {"surface_form": "福利", "quote": "五险一金"}, {"quote": ""}]}
    docs = spark.createDataFrame([(1, "s", t, [(t.index("五险"), len(t))])], "doc_id long, source_id string, text string, boilerplate_spans array<struct<start:int,end:int>>")
    claims, lost = extract.extract_posting(spark.createDataFrame([(1, json.dumps(reply))], "doc_id long, content string"), docs)
    assert sorted((r.kind, r.text, r.necessity, r.quote) for r in claims.collect()) == [("competency", "能写", "required", "熟悉Java开发"), ("skill", "Go", "required", "了解Go语言")] and lost.first().discarded == 3  # the rule looks for the quote as it is


def test_quotes_are_looked_for_in_their_own_text_only(spark):
    """All texts have all quotes: every text against every quote would be 36 million hits."""
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source_id"), F.concat(F.lit("of the same words in ＪＡＶＡ "), F.col("id").cast("string")).alias("text"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("boilerplate_spans"))
    reply = json.dumps({"competencies": [{"statement": "T", "quote": "the same words"}], "skills": [{"surface_form": "Java", "quote": "JAVA"}, {"surface_form": "x", "quote": " "}]})
    began = time.time()
    claims, lost = extract.extract_posting(docs.select("doc_id", F.lit(reply).alias("content")), docs)
    assert {tuple(r) for r in claims.groupBy("kind", "start", "end", "quote").count().collect()} == {("competency", 3, 17, "the same words", n), ("skill", 21, 25, "ＪＡＶＡ", n)}
    assert time.time() - began < 60 and lost.agg(F.sum("discarded")).first()[0] == n


def test_resumes_meet_their_own_quotes_only(spark):
    n = 6000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("Go and the same words").alias("text"))
    reply = json.dumps({"skills": [{"surface_form": "w", "quote": "the same words"}]})
    vocabulary = spark.createDataFrame([("go", "Go", ["Go"])], "id string, name string, surfaces array<string>")
    began = time.time()
    skills, _, new = extract.extract_resume(docs, docs.select("doc_id", F.lit(reply).alias("content")), vocabulary)
    assert skills.count() == n and new.where("start = 7 and end = 21").count() == n and time.time() - began < 60


def test_texts_of_resumes_are_read_once(spark):
    n, read = 50, spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            read.add(len(f))
            yield f

    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("Go and 好的C语言 words").alias("text")).mapInPandas(count, "doc_id long, text string")
    reply = json.dumps({"skills": [{"surface_form": "w", "quote": "and"}, {"surface_form": "x", "quote": "语言"}]})
    vocabulary = spark.createDataFrame([("go", "Go", ["Go"]), ("c", "C", ["C语言", "ords"])], "id string, name string, surfaces array<string>")
    skills, evidence, new = extract.extract_resume(docs, spark.range(n).select(F.col("id").alias("doc_id"), F.lit(reply).alias("content")), vocabulary)
    assert skills.count() == 2 * n and evidence.count() == 3 * n and new.where("quote = 'and' and start = 3").count() == n
    assert read.value == n


def test_surfaces_are_decided_once(spark):
    vocabulary = spark.createDataFrame([("go", "Go", ["Go", "golang"]), ("react", "React", ["React", "React.js"])], "id string, name string, surfaces array<string>")
    s = spark.createDataFrame([("go",), ("Golang",), ("REACT",), ("react native",), ("cached",)], "surface string")
    known = spark.createDataFrame([("cached", "x", "llm", 0.5)], "surface string, skill_id string, decided_by string, confidence double")
    judge = lambda c: c.where("place = 1").select("surface", F.when(F.col("surface") == "go", "made-up").otherwise(F.col("skill_id")).alias("skill_id"), F.lit(0.8).alias("confidence"))
    got = {r.surface: (r.skill_id, r.decided_by) for r in extract.normalize_surfaces(s, vocabulary, known, judge).collect()}
    assert got == {"go": (None, "adjudicator"), "Golang": ("go", "exact"), "REACT": ("react", "exact"), "react native": ("react", "adjudicator"), "cached": ("x", "llm")}


def test_resumes_have_two_channels(spark):
    vocabulary = spark.createDataFrame([("go", "Go", ["Go"]), ("react", "React", ["React"])], "id string, name string, surfaces array<string>")
    docs = spark.createDataFrame([(1, "Go and Go, reactive systems, Go modules")], "doc_id long, text string")
    reply = {"skills": [{"surface_form": "REACT", "quote": "reactive systems"}, {"surface_form": "modules", "quote": "modules"}, {"surface_form": "Go", "quote": "Go"}, {"surface_form": "no", "quote": "absent"}]}
    skills, evidence, new = extract.extract_resume(docs, spark.createDataFrame([(1, json.dumps(reply))], "doc_id long, content string"), vocabulary)
    assert sorted((r.skill_id, r.level, r.surface, r.n_evidence) for r in skills.collect()) == [("go", 0, "Go", 3), ("react", 0, "REACT", 1)]
    assert evidence.count() == 5 and [r.surface for r in new.collect()] == ["modules"]


def test_layout_of_two_columns(spark):
    def line(x, y, t, size=10.0):
        return [(c, x + 6.0 * i, float(y), x + 6.0 * i + 5, y + 10.0, size) for i, c in enumerate(t) if c != " "]

    rows = line(20, 700, "left one") + line(20, 680, "left two") + line(320, 700, "Skills", 14.0) + line(320, 680, "right, two")
    chars = spark.createDataFrame([(1, 0, 600.0, *r) for r in reversed(rows)], "doc_id long, page int, page_width double, text string, x0 double, y0 double, x1 double, y1 double, size double")
    r = extract.page_layout(chars).first()
    assert r.text == "left one\nleft two\n\nSkills\nright, two" and [(t.label, r.text[t.start : t.end]) for t in r.titles] == [("Skills", "Skills")]
    df = extract.page_layout(chars).select(extract.span_geometry(F.lit(0), F.lit(8), F.transform("runs", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(0).alias("page"), x["x0"].alias("x0"), x["y0"].alias("y0"), x["x1"].alias("x1"), x["y1"].alias("y1")))).alias("g"))
    assert list(df.first().g.box) == [20.0, 700.0, 67.0, 710.0]


def test_coordinates(spark):
    df = spark.createDataFrame([([[0.1, 0.2, 0.3, 0.4]], None), ([[10.0, 20.0, 900.0, 40.0]], None), ([[10.0, 20.0, 300.0, 40.0]], None), ([[1.0, 2.0, 3.0, 4.0]], "VLM-x"), ([], None)], "b array<array<double>>, k string")
    space = extract.coordinate_space(F.col("b"), F.lit(600.0), F.lit(800.0), F.col("k"))
    got = [(r.s, None if r.p is None else [round(x, 6) if x is not None else None for x in r.p]) for r in df.select(space.alias("s"), extract.to_points(F.get("b", 0), F.lit(600.0), F.lit(800.0), space).alias("p")).collect()]
    assert [s for s, _ in got] == ["norm_0_1", "norm_0_1000", "pdf_points", "norm_0_1", "pdf_points"] and got[0][1] == [60.0, 480.0, 180.0, 640.0] and got[2][1] == [10.0, 760.0, 300.0, 780.0]


def test_lexicon():
    forms = [("C/C++", "C/C++"), ("Java", "Java"), ("JavaScript", "JavaScript"), ("机器学习", "ML"), ("ML", "ML"), ("C", "C 语言")]
    t = "熟悉javascript与 C/C++，JAVA，机器学习 ML"
    got = {(n, t[s:e]) for n, s, e in evaluate.lexicon_hits(t, forms)}
    assert got == {("JavaScript", "javascript"), ("C 语言", "C"), ("C++", "C++"), ("Java", "JAVA"), ("ML", "机器学习")}


def test_lexicon_levels_and_families(spark):
    docs = spark.createDataFrame([(1, "精通Java，熟悉Spark。加分项：了解Flink"), (2, None)], "doc_id long, text string")
    got = {r.name: (r.necessity, r.level_hint) for r in evaluate.lexicon_skills(docs, [(x, x) for x in ("Java", "Spark", "Flink")]).collect()}
    assert got == {"Java": ("required", 3), "Spark": ("required", 3), "Flink": ("bonus", 2)} or got["Flink"][0] == "bonus" and got["Java"] == ("required", 3)
    df = spark.createDataFrame([("数据开发", "算法"), ("销售", "算法"), ("销售", "x")], "title string, body string")
    assert [r[0] for r in df.select(evaluate.family_of(F.col("title"), F.col("body"), {"ai": "算法", "data": "数据"}, "none")).collect()] == ["data", "ai", "none"]


def test_ontology_errors(spark):
    rows = [("skill.a", "skill.b", "c1", ["x"]), ("skill.b", "skill.a", "c1", ["x"]), ("skill.c", "skill.none", "c2", []), ("bad", "bad", "c1", ["x"]), ("skill.d", None, "c1", ["x"]), ("skill.d", None, "c1", ["y"])]
    skills = spark.createDataFrame(rows, "id string, parent_id string, cluster_id string, aliases array<string>")
    aliases = spark.createDataFrame([("X", "skill.a"), ("x", "skill.b"), ("y", "skill.zz")], "surface string, skill_id string")
    got = {r["check"]: r.n for r in evaluate.ontology_errors(skills, aliases, spark.createDataFrame([("c1",)], "cluster_id string"), 6).collect()}
    assert got == {"few_skills": 0, "few_aliases": 1, "repeated_id": 1, "malformed_id": 1, "no_alias": 1, "unknown_cluster": 1, "unknown_parent": 1, "own_parent": 1, "unknown_target": 1, "alias_conflict": 1, "parent_cycle": 2}


def test_streamed_duplicates_equal_the_batch(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    titles = ["Java开发工程师", "java 研发", "Senior Data Analyst of Things", "Senior Data Analyst of Thing", "销售"]
    rows = [(i, day + datetime.timedelta(days=i), ["a", "b", "b", "a", "", None][i % 6] if i % 10 == 9 else "ab"[i % 2], [None, "", "岗"][i % 3] if i % 11 == 10 else titles[i % 5]) for i in range(300)]
    shape = "posting_id long, ts timestamp, company string, title string"
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * k + 100], shape).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {r.posting_id: r.duplicate_of for r in arrivals.drain(arrivals.duplicates(stream, ["company"])).collect()}
    assert len(got) == 300 and got == duplicates_by_force([(i, t.date(), c, "x", title) for i, t, c, title in rows])


def test_streamed_blocks_share_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrivals, "GROUPS", 2)
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(days=i // 4), f"c{i % 40}", ["Java", "Data"][i % 3 % 2]) for i in range(240)]
    shape = "posting_id long, ts timestamp, company string, title string"
    for k in range(2):
        spark.createDataFrame(rows[120 * k : 120 * k + 120], shape).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = {r.posting_id: r.duplicate_of for r in arrivals.drain(arrivals.duplicates(stream, ["company"])).collect()}
    assert got == duplicates_by_force([(i, t.date(), c, "x", title) for i, t, c, title in rows])


def test_role_bands_and_pages(spark):
    df = spark.createDataFrame([("Junior dev",), ("高级工程师",), ("Senior intern",), (None,), ("dev",)], "name string")
    assert [r[0] for r in df.select(graph.role_band(F.col("name"))).collect()] == ["junior", "senior", None, None, None]
    obs = spark.createDataFrame([("r", "a", "2024Q1", 0.1), ("r", "b", "2024Q2", 0.2), ("q", "a", "2024Q2", 0.3)], "role_id string, skill_id string, period string, weight double")
    assert [r.skill_id for r in pages.role_skills(obs, "r", "2024Q2").collect()] == ["b"] and [r.skill_id for r in pages.role_skills(obs, "r", "2024Q4").collect()] == ["a", "b"]
    assert pages.optional(obs, role_id="r", period=None).count() == 2 and pages.current_period(obs) == "2024Q2"
