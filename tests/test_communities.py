"""Communities by rounds against planted ones and one task's modularity; versions of the ontology; pairs that are asked for."""

import random

from pyspark.sql import functions as F

from tempograph.operators import evolve, match, review


def noisy(spark, groups=8, size=7, seed=3):
    r = random.Random(seed)
    rows = [(f"n{g:02}{i}", f"n{g:02}{j}", r.choice([2.0, 3.0])) for g in range(groups) for i in range(size) for j in range(i) if r.random() < 0.8]
    rows += [(f"n{r.randrange(groups):02}{r.randrange(size)}", f"n{r.randrange(groups):02}{r.randrange(size)}", 0.5) for _ in range(20)]
    rows += [("n000", "n000", 9.0), ("n000", "n001", -1.0), ("zz", "zy", 0.0)]
    return spark.createDataFrame(rows, "a string, b string, weight double")


def test_rounds_find_planted_communities(spark):
    e = noisy(spark)
    one, many = evolve.louvain(e), evolve.louvain(e, at_once=0)
    groups = lambda df: {frozenset(r.s) for r in df.groupBy("cluster_id").agg(F.collect_list("skill_id").alias("s")).collect()}
    assert groups(many) == groups(one) and len(groups(many)) == 8
    a, b = evolve.modularity(e, one), evolve.modularity(e, many)
    assert abs(a - b) < 1e-9 and a > 0.6
    assert [r.cluster_id for r in many.select("cluster_id").distinct().orderBy("cluster_id").collect()] == [f"cluster-{i}" for i in range(8)]
    assert evolve.louvain(e.limit(0), at_once=-1).count() == 0 and evolve.modularity(e.limit(0), one.limit(0)) == 0.0


def obs(spark, rows):
    return spark.createDataFrame(rows, "role_id string, skill_id string, period string, weight double, ontology_version string")


def test_drift_of_one_version_with_reasons(spark):
    before = obs(spark, [("r", "a", "2024Q1", 0.4, "1"), ("r", "b", "2024Q1", 0.3, "1"), ("q", "a", "2024Q1", 0.4, "1"), ("m", "a", "2024Q1", 0.4, "1"), ("m", "b", "2024Q1", 0.4, "2")])
    after = obs(spark, [("r", "a", "2024Q2", 0.2, "1"), ("r", "c", "2024Q2", 0.125, "1"), ("q", "a", "2024Q2", 0.9, "2"), ("m", "a", "2024Q2", 0.9, "1")])
    got = {r.skill_id: (r.kind, r.reason) for r in evolve.drift(before, after).collect()}
    assert got == {"a": ("modified", "技能点 a 重要度由 0.40 变为 0.20（相对变化 50%）"), "b": ("removed", "技能点 b 在 2024Q2 从岗位能力要求中消失（此前重要度 0.30）"), "c": ("added", "技能点 c 在 2024Q2 首次达到显著重要度 （0.12），上一时间片不存在或低于噪声地板 0.05")}
    assert evolve.drift(before.drop("ontology_version"), after.drop("ontology_version")).select("role_id").distinct().count() == 3


def test_series_are_of_the_last_version(spark):
    lead = obs(spark, [("r", s, p, w, v) for s, p, w, v in (("a", "2023Q4", 0.1, "2"), ("a", "2024Q1", 0.1, "1"), ("a", "2024Q2", 0.2, "2"), ("b", "2024Q1", 0.3, "1"), ("b", "2024Q2", 0.4, "2"))])
    lag = obs(spark, [("r", s, p, w, v) for s, p, w, v in (("a", "2023Q4", 0.5, "2"), ("a", "2024Q1", 0.6, "1"), ("a", "2024Q2", 0.7, "2"), ("b", "2024Q1", 0.8, "1"), ("b", "2024Q2", 0.9, "1"))])
    assert sorted(map(tuple, evolve.aligned(lead, lag, ["skill_id"]).collect())) == [("a", "2023Q4", 0.1, 0.5), ("a", "2024Q2", 0.2, 0.7), ("b", "2024Q1", 0.3, 0.8)]


def test_pairs_that_are_asked_for(spark):
    profiles = spark.createDataFrame([("p", "a", 2), ("p", "x", 1), ("q", "b", 1)], "profile_id string, skill_id string, level int")
    specs = spark.createDataFrame([(r, s, "required", 1.0, 2) for r in ("r1", "r2", "r3") for s in ("a", "b")], "role_id string, skill_id string, necessity string, importance double, required_level int")
    burst = spark.createDataFrame([], "skill_id string, burst double")
    pairs = spark.createDataFrame([("p", "r1"), ("q", "r2"), ("p", "r1")], "profile_id string, role_id string")
    key = ["profile_id", "role_id"]
    for whole, asked in ((match.judge(profiles, specs), match.judge(profiles, specs, pairs)), (match.metrics(profiles, specs), match.metrics(profiles, specs, pairs=pairs)), (match.surplus(profiles, specs), match.surplus(profiles, specs, pairs)), (match.diagnose(profiles, specs, burst), match.diagnose(profiles, specs, burst, pairs))):
        want = whole.join(pairs.distinct(), key, "left_semi")
        assert sorted(map(str, asked.select(want.columns).collect())) == sorted(map(str, want.collect())) and asked.count()


def test_evidence_in_the_order_of_asking(spark):
    asked = spark.createDataFrame([(2, "e1"), (0, "e2"), (1, "none"), (3, "e2")], "place long, evidence_id string")
    evidence = spark.createDataFrame([("e1", "s", "d1", "q1", "ac:k"), ("e2", "s", None, "q2", "llm")], "evidence_id string, source_id string, doc_id string, quote string, extractor string")
    docs = spark.createDataFrame([("d1", "resume", "\n".join("ab"))], "doc_id string, kind string, text string")
    got = review.evidence_details(asked, evidence, docs).collect()
    assert [(r.place, r.evidence_id, r.skill_id, r.doc_id, r.kind, r.text) for r in got] == [(0, "e2", None, "e2", "posting", "q2"), (2, "e1", "k", "d1", "resume", "a\nb"), (3, "e2", None, "e2", "posting", "q2")]
    assert [(x.text, round(x.y, 3)) for x in got[1].lines] == [("a", 0.04), ("b", 0.075)]


def test_paths_over_a_graph_that_is_not_sent(spark):
    r = random.Random(6)
    edges = spark.createDataFrame([(f"s{r.randrange(40)}", f"s{r.randrange(40)}") for _ in range(90)], "src string, dst string")
    targets = spark.createDataFrame([(p, f"s{r.randrange(40)}", r.randrange(9) / 4) for p in range(12) for _ in range(4)], "profile_id long, skill_id string, urgency double")
    known = spark.createDataFrame([(p, f"s{r.randrange(40)}") for p in range(14) for _ in range(5)], "profile_id long, skill_id string")
    for done in (known, None):
        whole, own = (sorted(map(str, match.learning_path(targets, edges, done, most=m).collect())) for m in (1000, 0))
        assert whole == own and len(whole) > 48


def test_graphs_without_links_need_no_rounds(spark, monkeypatch):
    written = []
    keep = evolve.kept
    monkeypatch.setattr(evolve, "kept", lambda df: written.append(1) or keep(df))
    loops = spark.createDataFrame([("a", "a", 2.0), ("b", "b", 1.0)], "src string, dst string, weight double")
    assert {tuple(r) for r in evolve._moved(loops, 1.0, 42, 24).collect()} == {("a", "a"), ("b", "b")}
    assert len(written) == 1
    pair = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0)], "src string, dst string, weight double")
    assert {r.part for r in evolve._moved(pair, 1.0, 42, 24).collect()} in ({"a"}, {"b"})
