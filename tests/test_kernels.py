"""Kernels on worked examples."""

import datetime
import hashlib
import math
import random
import unicodedata

from pyspark.sql import functions as F

from tempograph import schema
from tempograph.functions import text
from tempograph.operators import evaluate, evolve, graph, match


def series(spark, counts, totals, skill="s"):
    quarters = [f"{2000 + i // 4}Q{i % 4 + 1}" for i in range(len(counts))]
    return spark.createDataFrame([(skill, p, c, t, c / t) for p, c, t in zip(quarters, counts, totals)], "skill_id string, period string, posting_count long, total_postings long, weight double")


def test_burst_is_found_in_its_window(spark):
    b = evolve.bursts(series(spark, [25] * 8 + [200] * 4 + [25] * 8, [500] * 20), ["skill_id"]).collect()
    assert [(r.start_period, r.end_period) for r in b] == [("2002Q1", "2002Q4")] and b[0].weight > 0


def test_volume_alone_is_no_burst(spark):
    assert evolve.bursts(series(spark, [10, 20, 40, 80, 160, 320], [100, 200, 400, 800, 1600, 3200]), ["skill_id"]).count() == 0
    assert evolve.bursts(series(spark, [5] * 6, [5] * 6), ["skill_id"]).count() == 0


def test_mann_kendall_worked_example(spark):
    rows = spark.createDataFrame([("s", f"200{i}Q1", float(v)) for i, v in enumerate([1, 3, 2, 5, 5])], "skill_id string, period string, weight double")
    r = evolve.mann_kendall(rows, ["skill_id"]).first()
    assert r.s == 7 and abs(r.var_s - 15.6666667) < 1e-6 and abs(r.slope - 1) < 1e-9


def test_lead_lag_of_three(spark):
    rng = random.Random(3)
    x = [rng.random() for _ in range(28)]
    obs = lambda v: series(spark, [int(1000 * a) for a in v], [1000] * len(v))
    r = evolve.lead_lag(obs(x[3:] + [0.5] * 0), obs(x[:-3]), ["skill_id"]).first()
    assert r.lag_periods == 3 and r.correlation > 0.5


def test_f_tail_of_known_quantile():
    assert abs(evolve.f_tail(4.10282, 2, 10) - 0.05) < 1e-4 and evolve.f_tail(0, 2, 3) == 1.0


def test_drift_kinds(spark):
    rows = lambda p, w: spark.createDataFrame([("r", s, x, p) for s, x in w.items()], "role_id string, skill_id string, weight double, period string")
    d = evolve.drift(rows("2024Q1", {"a": 0.40, "b": 0.30, "d": 0.08}), rows("2024Q2", {"a": 0.42, "c": 0.25, "d": 0.20}))
    assert {r.skill_id: r.kind for r in d.collect()} == {"b": "removed", "c": "added", "d": "modified"}


def test_acyclic_keeps_the_first_two(spark):
    rows = [("a", "b", "asymmetry", 0.9), ("b", "c", "asymmetry", 0.8), ("c", "a", "asymmetry", 0.7), ("b", "a", "asymmetry", 0.6)]
    kept = graph.select_acyclic(spark.createDataFrame(rows, "src string, dst string, rule string, confidence double")).collect()
    assert {(r.src, r.dst) for r in kept} == {("a", "b"), ("b", "c")}


def test_louvain_two_cliques(spark):
    edges = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 0.1)]
    c = evolve.louvain(spark.createDataFrame(edges, "a string, b string, weight double")).collect()
    assert sorted("".join(sorted(r.skill_id for r in c if r.cluster_id == k)) for k in {r.cluster_id for r in c}) == ["abcd", "wxyz"]


def test_fuzzy_duplicates_per_company(spark):
    rows = [(10 * c + i, f"2024-01-{1 + i:02d}", f"company{c}", "x", f"Senior Data Analyst{'.' * i}") for c in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, "posting_id long, day string, company string, city string, title string").withColumn("day", F.to_date("day"))
    assert text.greedy_duplicates(df, ["company", "city"], least=85.0).where("duplicate_of is not null").count() == 80


def test_scan_is_longest_and_whole_word():
    s = text.Surfaces({"java": "j", "javascript": "js", "c": "c", "语言": "l", "script ja": "x"})
    t = "javascript java, c语言 abc"
    assert list(s.mentions(t)) == [(0, 10, "javascript"), (11, 15, "java"), (17, 18, "c"), (18, 20, "语言")]
    every = [(i, i + len(p), p) for i in range(len(t)) for p in sorted(s.skill_of, key=len, reverse=True) if t.startswith(p, i)]
    assert list(s.all_hits(t)) == every


def test_ambiguous_aliases(spark):
    df = spark.createDataFrame([("rs", "Rust"), ("JS", "JavaScript"), ("go", "go"), ("r2d", "R2D2"), ("语言", "l"), ("node", "Node"), ("12", "n")], "s string, n string")
    assert [r[0] for r in df.where(text.too_ambiguous(F.col("s"), F.col("n"))).collect()] == ["rs", "r2d"]


def test_titles_spans_and_similarity(spark):
    assert text.title_key("数据 研发工程师") == text.title_key("数据-开发（工程师）") == "数据开发"
    assert len({text.title_key(t) for t in ("Java开发工程师", "JAVA 开发", "java研发工程师", "Ｊａｖａ（研發）", "java_开发/工程師", "Java—开发 岗位")}) == 1
    assert [text.title_key(t) for t in ("产品经理", "Data Engineer", "会计专员岗", "岗", "测试岗位职位", "a\\b")] == ["产品经理", "dataengineer", "会计专员", "", "测试岗位", "ab"]
    assert text.indel("kitten", "sitting") == 200 * 4 / 13 and text.indel("", "") == 100
    df = spark.sql("SELECT array(named_struct('start', 5, 'end', 9), named_struct('start', 0, 'end', 3), named_struct('start', 3, 'end', 4)) AS s")
    assert [tuple(x) for x in df.select(text.merge_spans(F.col("s"))).first()[0]] == [(0, 4), (5, 9)]


def duplicates_by_force(rows, days=60, least=92.0):
    """rows (id, day, company, city, title) in arrival order."""
    kept, out = [], {}
    for i, day, company, city, title in rows:
        key = text.title_key(title or "")
        out[i] = None
        if key and company and city and day:
            out[i] = next((k for k, d, c, t, x in kept if (c, t) == (company, city) and abs((d - day).days) <= days and (x == key or text.indel(x, key) >= least)), None)
        if out[i] is None and day:
            kept.append((i, day, company, city, key))
    return out


def test_duplicates_equal_a_sequential_scan(spark):
    rng = random.Random(5)
    day = datetime.date(2024, 1, 1)
    titles = ["Java开发工程师", "java 研发", "Java开发 (急)", "senior data analyst of things", "Senior Data Analyst of Thing", "销售", "", None, "岗"]
    rows = [(i, None if rng.random() < 0.05 else day + datetime.timedelta(days=rng.randrange(300)), rng.choice(["a", "b", "", None]), rng.choice(["x", "y", None]), rng.choice(titles)) for i in range(600)]
    df = spark.createDataFrame(rows, "posting_id long, day date, company string, city string, title string")
    got = {r.posting_id: r.duplicate_of for r in text.greedy_duplicates(df, ["company", "city"], order=("posting_id",)).collect()}
    assert got == duplicates_by_force(rows) and sum(v is not None for v in got.values()) > 20
    exact = {r.posting_id: r.duplicate_of for r in text.greedy_duplicates(df, ["company", "city"], least=None, order=("posting_id",)).collect()}
    assert exact == duplicates_by_force(rows, least=101)


def places_by_force(t, q):
    found = [(i, i + len(q)) for i in range(len(t)) if t.startswith(q, i)] if q.strip() else []
    if found or not q.strip():
        return found
    chars = [(x, i) for i, c in enumerate(t) for x in unicodedata.normalize("NFKC", c) if not x.isspace()]
    flat, quote = "".join(x for x, _ in chars), "".join(x for c in q for x in unicodedata.normalize("NFKC", c) if not x.isspace())
    return [(chars[i][1], chars[i + len(quote) - 1][1] + 1) for i in range(len(flat)) if quote and flat.startswith(quote, i)]


def test_quotes_are_found_everywhere(spark, monkeypatch):
    texts = ["aaaa", "熟悉 Java\n开发，Ｊａｖａ", "a longer passage of words, a longer  passage of words", "", None, "x" * 50, "ﬁne ﬁt"]
    quotes = ["aa", "Java开发", "Java", "a longer passage of words", " ", "", "xxxxxxxxx", "fine", "e fi", "nowhere"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    want = sorted((i, d, s, e) for d, t in enumerate(texts) for i, x in enumerate(quotes) if t for s, e in places_by_force(t, x))
    assert sorted(map(tuple, text.locate(docs, q).collect())) == want and len(want) > 40
    monkeypatch.setattr(text, "MAX_QUOTES", 0)
    assert sorted(map(tuple, text.locate(docs, q).collect())) == want
    hints = spark.createDataFrame([(0, 0, 2), (6, 5, 40)], "item_id long, doc_id long, hint int")
    parts = spark.createDataFrame([(5, 0, 30), (5, 30, 39), (5, 39, 50)], "doc_id long, part_start int, part_end int")
    got = {(r.item_id, r.doc_id): r.start for r in text.pick_places(text.locate(docs, q), hints, parts).collect()}
    assert got[0, 0] == 2 and got[6, 5] == 40 and got[2, 1] == 3


def test_benefits_and_blocks_of_peers(spark):
    t = "负责开发。\n公司提供免费零食下午茶和周末双休，双休。\n我们一起努力工作吧。短。"
    u = "别的。\n我们一起努力工作吧。"
    docs = spark.createDataFrame([(1, "a", t), (2, "a", u), (3, "b", u), (4, None, t), (5, "a", None), (6, "a", "12345678901234567。"), (7, "a", "1234567。x"), (8, "a", "1234567。y")], "doc_id long, company string, text string")
    got = {r.doc_id: [t2[s["start"] : s["end"]] if (t2 := {1: t, 2: u, 4: t, 7: "1234567。x"}.get(r.doc_id)) else (s["start"], s["end"]) for s in r.spans] for r in text.boilerplate(docs, "company").collect()}
    assert got[1] == ["零食下午茶", "周末双休", "双休", "我们一起努力工作吧。"] and got[2] == ["我们一起努力工作吧。"] and got[3] == [] and got[4] == ["零食下午茶", "周末双休", "双休"]
    assert got[5] == got[6] == [] and got[7] == ["1234567。"]


def test_paths_with_cycles_and_known_skills():
    before = {"b": ["a"], "c": ["b", "k"], "x": ["y"], "y": ["x", "z"], "k": ["j"], "w": ["x"]}
    steps = match.plan_path({"c": 1.0, "x": 2.0, "y": 0.5, "w": 9.0}, before, {"k"})
    assert [s["skill_id"] for s in steps] == ["z", "x", "y", "w", "a", "b", "c"]
    assert {s["skill_id"] for s in steps if s["in_cycle"]} == {"x", "y"} and {s["skill_id"] for s in steps if s["implicit"]} == {"z", "a", "b"}
    assert steps[0]["urgency"] == 9.0 and steps[6]["blocking"] == ["b"] and steps[6]["prerequisites"] == ["b", "k"]
    assert steps[1]["reason"].startswith("依赖图存在环") and steps[4]["reason"] == "作为后续技能点的前置被纳入路径；当前可学（前置已掌握或不存在）；紧迫度为 1.00"


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"s{i}", f"s{i + 1}") for i in range(100)], "src string, dst string")
    assert match.closure(edges).count() == 101 * 100 // 2
    # s1 to s50 need what is before them; s52 to s100 what is between s50 and them.
    assert match.closure(edges, spark.createDataFrame([("s50",)], "skill_id string")).count() == 51 * 50 // 2 + 50 * 49 // 2


def test_gold_rules(spark):
    jobs = spark.createDataFrame([("j", "java", f"s{i}", "java" if i < 5 else "data", "required", None) for i in range(10)] + [("j", "java", "team", "soft", "required", None), ("e", "data", "s0", "java", "bonus", 1)], "job_id string, job_family string, skill_id string, family string, necessity string, level_hint int")
    held = {"all": range(10), "seven": range(2, 9), "four": range(4), "three": [5, 6, 7], "two": [0, 1]}
    p = spark.createDataFrame([(k, f"s{i}", 2, "data" if k == "three" else "java") for k, v in held.items() for i in v], "profile_id string, skill_id string, level int, family string")
    rows = match.gold_coverage(p, jobs).join(match.skill_family(p), "profile_id", "left").withColumns({"edu_ok": F.lit(True), "exp_ok": F.lit(False)})
    got = {(r.profile_id, r.job_id): (r.rule, r.tier) for r in match.gold_tier(rows).collect()}
    assert got["all", "j"] == ("R4", "strong") and got["seven", "j"] == ("R6", "gapped") and got["four", "j"] == ("R6", "gapped") and got["two", "j"] == ("R2", "mismatch") and got["three", "j"] == ("R1", "mismatch")
    assert got["all", "e"] == ("R2", "mismatch")
    edu = spark.createDataFrame([("本科", "硕士", False), ("博士", "硕士", True), (None, "大专", False), (None, "不限", True), ("x", "", True)], "a string, b string, ok boolean")
    assert all(r.ok == r.got for r in edu.withColumn("got", match.education_fits(F.col("a"), F.col("b"))).collect())


def test_inflation_needs_rising_density(spark):
    loads = lambda chars: spark.createDataFrame([(f"200{i}Q1", 100, 400 + 80 * i, chars(i)) for i in range(6)], "period string, n_postings long, n_skill_mentions long, total_text_chars long")
    rising = evolve.inflation_report(loads(lambda i: 20_000)).first()
    assert rising.inflated and rising.density_trend == "increasing" and rising.density_p_value < 0.05
    points = evolve.inflation(loads(lambda i: 20_000)).orderBy("period").collect()
    assert points[0].adjustment == 1 and abs(points[-1].adjustment - 0.5) < 1e-9
    flat = loads(lambda i: 50 * (400 + 80 * i))
    report = evolve.inflation_report(flat).first()
    assert not report.inflated and report.posting_trend == "increasing" and report.density_trend == "no trend" and report.density_p_value == 1
    assert {r.adjustment for r in evolve.inflation(flat).collect()} == {1.0}


def test_normal_tail(spark):
    z = [0.0, 0.5, -1.0, 1.959964, 2.9, 3.1, 5.0, -8.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select(evolve.normal_tail(F.col("z"))).collect()
    assert all(abs(r[0] - math.erfc(abs(x) / math.sqrt(2))) < 1e-9 * max(1, 0) + 1e-6 * math.erfc(abs(x) / math.sqrt(2)) for r, x in zip(got, z))


def test_granger_finds_a_leading_series(spark):
    rng = random.Random(3)
    x = [rng.random() for _ in range(40)]
    y = [0.5] + [0.8 * a + 0.05 * rng.random() for a in x[:-1]]
    lag = spark.createDataFrame([("s", 1)], "skill_id string, lag_periods long")
    one = lambda v: series(spark, [int(1e6 * a) for a in v], [10**6] * len(v))
    ahead, back = (evolve.granger(one(a), one(b), ["skill_id"], lag).first() for a, b in ((x, y), (y, x)))
    assert ahead.lag_order == 1 and ahead.p_value < 1e-6 and back.p_value > 0.01


def test_emerging_role_is_discovered(spark):
    ids = ["agent", "rag", "vector"]
    edges = [(s, p, a, b, 5.0) for s in ("s1", "s2", "s3") for p in ("2024Q1", "2024Q2", "2024Q3", "2024Q4") for i, a in enumerate(ids) for b in ids[i + 1 :]] + [("s1", "2023Q1", "old", "older", 1.0)]
    e = spark.createDataFrame(edges, "source_id string, period string, a string, b string, weight double")
    bursts, roles = spark.createDataFrame([("agent",), ("rag",)], "skill_id string"), spark.createDataFrame([("r", "old"), ("r", "older")], "role_id string, skill_id string")
    none, hit = ([("1", "cook", ["pan"])], [("1", "Agent-RAG-Vector builder", ["pan"])])
    table = lambda rows: spark.createDataFrame(rows, "code string, name string, skill_ids array<string>")
    got = evolve.discover_emerging(e, bursts, roles, table(none), "v1").collect()
    assert len(got) == 1 and got[0].skill_ids == ids and got[0].zone == "publish" and got[0].role_id == "cand-" + hashlib.md5(b"v1:agent,rag,vector").hexdigest()[:12] and got[0].evidence_count == 3 + 2 + 3
    assert evolve.discover_emerging(e, bursts, roles, table(hit), "v1").count() == 0
    assert evolve.discover_emerging(e, bursts, roles, table(none), "v1", current="2023Q1").count() == 0


def test_drift_needs_both_slices(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "role_id string, skill_id string, weight double, period string")
    d = evolve.drift(rows(("r", "a", 0.4, "2024Q1"), ("q", "a", 0.4, "2024Q1")), rows(("r", "b", 0.3, "2024Q2"), ("n", "b", 0.3, "2024Q2"))).collect()
    assert {(x.role_id, x.skill_id, x.kind, x.occurred_on) for x in d} == {("r", "a", "removed", "2024-04-01"), ("r", "b", "added", "2024-04-01")}


def test_periods(spark):
    assert schema.previous_period("2024Q1") == "2023Q4"
    r = spark.sql("SELECT '2024Q1' AS p").select(schema.first_day(F.col("p")).cast("string"), schema.last_day(F.col("p")).cast("string"), schema.consecutive_quarters(F.col("p"), F.lit(3))).first()
    assert tuple(r) == ("2024-01-01", "2024-03-31", ["2024Q1", "2024Q2", "2024Q3"])


def test_ranks_that_are_all_tied(spark):
    rows = spark.createDataFrame([("a", "x", 0.3, 0.1), ("a", "y", 0.2, 0.1), ("b", "x", 0.3, 0.1), ("b", "y", 0.2, 0.3), ("c", "x", 0.1, 0.1)], "period string, item string, predicted double, gold double")
    got = {r.period: (round(r.spearman, 9), round(r.ndcg, 6)) for r in evaluate.rank_measures(rows, "period").collect()}
    assert got["a"] == (0.0, 1.0) and got["b"][0] == -1.0 and got["c"] == (0.0, 1.0)


def shuffled(spark) -> int:
    return spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_bands_travel_as_two_numbers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = shuffled(spark)
    assert text.near_blocks(docs, "source").count() > 5
    assert shuffled(spark) - before < 2_000_000


def test_scans_take_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit("a Java b").alias("text"))
    hits = text.scan(docs, {"Java": "java"})
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000 and hits.count() == 3000


def test_edges_are_read_once_for_clusters_and_gates(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(w):
        read.add(1)
        return w

    ids = ["agent", "rag", "vector"]
    rows = [(s, p, a, b, 5.0) for s in ("s1", "s2", "s3") for p in ("2024Q1", "2024Q2", "2024Q3", "2024Q4") for i, a in enumerate(ids) for b in ids[i + 1 :]]
    e = spark.createDataFrame(rows, "source_id string, period string, a string, b string, weight double").withColumn("weight", counted("weight"))
    bursts, roles = spark.createDataFrame([("agent",), ("rag",)], "skill_id string"), spark.createDataFrame([("r", "old")], "role_id string, skill_id string")
    none = spark.createDataFrame([("1", "cook", ["pan"])], "code string, name string, skill_ids array<string>")
    assert len(evolve.discover_emerging(e, bursts, roles, none, "v1").collect()) == 1 and read.value == len(rows)
