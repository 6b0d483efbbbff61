"""Values of vacancies and payload mappers on worked examples."""

import json
import random

from pyspark.sql import functions as F

from tempograph.functions import text, vacancy
from tempograph.operators import review
from tempograph.sources import files, payloads


def values(spark, rows, f):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{j} string" for j in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [r.v for r in df.select("i", f(*[F.col(c) for c in df.columns[1:]]).alias("v")).orderBy("i").collect()]


def test_whole_numbers(spark):
    assert values(spark, ["12.9", "-3.7", "", "x", None, "1e3", "nan"], vacancy.whole_number) == [12, -3, None, None, None, 1000, None]


def test_days(spark):
    assert [str(v) for v in values(spark, ["2024-03-05T10:00", "2024-3-5", "2024-13-01", None], vacancy.day_of)] == ["2024-03-05", "None", "None", "None"]
    assert [str(v) for v in values(spark, ["1709596800000", "1709596800", "x"], vacancy.day_of_epoch)] == ["2024-03-05", "2024-03-05", "None"]


def test_salary_ranges(spark):
    got = values(spark, ["15-30K", "15 – 30", "15000-30000元", "2.5-3千", "面议", "", None], vacancy.salary_range)
    assert [tuple(v) for v in got] == [(15000, 30000), (15000, 30000), (15000, 30000), (2500, 3000), (None, None), (None, None), (None, None)]


def test_salary_summaries(spark):
    rows = ["1-2万", "15K-25K", "15K-20", "24万-36万/年", "10-20", "面议", "100-200元/小时", "8000至12000", ""]
    want = [(10000, 20000), (15000, 25000), (15000, 20), (20000, 30000), (10000, 20000), (None, None), (None, None), (8000, 12000), (None, None)]
    assert [tuple(v) for v in values(spark, rows, vacancy.salary_summary)] == want


def test_necessity(spark):
    t = "任职要求：熟悉Java。" + "x" * 200 + "加分项：Go"
    rows = [("Java", t), ("Go", t), ("absent", "Java"), ("", "加分"), ("精通Go", "有经验优先，精通Go")]
    assert values(spark, rows, vacancy.necessity) == ["required", "bonus", None, None, "required"]


def test_spans(spark):
    df = spark.createDataFrame([([(2, 6), (10, 12)],)], "s array<struct<start:int,end:int>>")
    held = lambda a, b: vacancy.covered(F.lit(a), F.lit(b), F.col("s"))
    met = lambda a, b: vacancy.overlaps(F.lit(a), F.lit(b), F.col("s"))
    assert list(df.select(held(3, 5).alias("a"), held(4, 7).alias("b"), held(5, 9).alias("c"), met(6, 10).alias("d"), met(5, 7).alias("e")).first()) == [True, True, False, False, True]
    assert df.select(vacancy.blank(F.lit("abcdefghijk"), F.col("s"))).first()[0] == "ab    ghij "


def test_sections(spark):
    docs = spark.createDataFrame([(1, "me\n教育经历：\nx\nSKILLS\ny"), (2, "plain"), (3, None), (4, "Project\nz")], "doc_id long, text string")
    got = sorted(tuple(r) for r in vacancy.segments(docs).collect())
    assert got == [(1, "basic", 0, 3), (1, "education", 3, 11), (1, "skill", 11, 19), (2, "full", 0, 5), (3, "full", 0, 0), (4, "project", 0, 9)]


def test_redaction(spark):
    rows = ["微信号：ab_cdef1 call 13812345678", "wx ab12345", "id 11010119900101123X.", "13812345678,13912345678,13712345678", "a.b@c.io", "213812345678"]
    r = text.REDACTED
    assert values(spark, rows, text.redact) == [f"{r} call {r}", r, f"id {r}.", f"{r},{r},{r}", r, "213812345678"]


def test_postings_of_payloads(spark):
    rows = [("lever", {"board_name": "B", "job": {"id": "7", "text": "Dev 13812345678", "description": "<p>a</p><p>b</p>", "createdAt": 1709596800000, "salaryRange": {"min": "10.5"}}}), ("else", {"text": "seen by a@b.io"}), ("ashby", {"job": {"title": "T", "compensation": {"compensationTiers": [{"components": [{"compensationType": "Salary", "minValue": 5, "maxValue": 9}]}]}}})]
    s = spark.createDataFrame([(f"s{i}", n, "h" * 40, json.dumps(p)) for i, (n, p) in enumerate(rows)] + [("s9", "moka", "g" * 40, "no json"), ("s8", "moka", "f" * 40, None)], "id string, source_id string, content_hash string, payload string")
    got = {r.snapshot_id: r for r in payloads.to_postings(s).collect()}
    assert (got["s0"].posting_id, got["s0"].title, got["s0"].description, str(got["s0"].published_at), got["s0"].salary_min) == ("lever:7", f"Dev {text.REDACTED}", "a\nb", "2024-03-05", 10)
    assert (got["s1"].posting_id, got["s1"].title) == ("else:" + "h" * 32, f"seen by {text.REDACTED}")
    assert (got["s2"].salary_min, got["s2"].salary_max) == (5, 9)
    assert got["s9"].title == got["s8"].title == "" and got["s9"].posting_id == "moka:" + "g" * 32


def test_near_blocks_equal_brute_force(spark):
    lines = ["the quick brown fox jumps over the dog", "the quick brown fox jumps over the dogs", "nothing like it at all here", "The quick brown fox jumps over the dog", "short", "", None, "the quick brown fox jumped over a dog", "said twice in one text\nsaid twice in one text", "a text by itself is no peer\na text by itself is no peer!", "equal in two texts here", "equal in two texts here\nx"]
    rows = [(i, "s" if i % 3 else "t", t) for i, t in enumerate(lines)] + [(100 + i, "s", f"many near copies of one line, this is number {i:03d}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    g = lambda t: {t.casefold()[i : i + 3] for i in range(len(t) - 2)}
    blocks = {(s, t, b) for _, s, t in rows if t for b in t.split("\n") if len(b) >= 8}
    want = {(s, b) for s, t, b in blocks for s2, t2, b2 in blocks if s == s2 and t != t2 and len(g(b) & g(b2)) >= 0.8 * len(g(b) | g(b2))}
    got = [(r.source, r.block) for r in text.near_blocks(docs, "source").collect()]
    assert set(got) == want and len(got) == len(want) > 40


def test_trace_flags(spark):
    shape = "doc_id long, name string, start int, end int, surface string, box array<double>"
    gold = spark.createDataFrame([(1, "Go", 0, 2, "Go", [0.0, 0.0, 1.0, 1.0]), (1, "C", 3, 4, "C", None), (1, "Java", 9, 13, "Java", None)], shape)
    pred = spark.createDataFrame([(1, "Go", 0, 2, "go", [0.0, 0.0, 1.0, 0.9]), (1, "C", 2, 3, "C", None), (1, "Rust", 0, 1, "R", None)], shape)
    docs = spark.createDataFrame([(1, "Go C")], "doc_id long, text string")
    got = {r.name: tuple(r)[2:] for r in review.trace_flags(pred, gold, docs).collect()}
    assert got == {"Go": (True, True, True, True), "C": (False, True, False, False)}


def test_accepted_aliases_and_skill_of(spark):
    claims = spark.createDataFrame([(1, "golang", "go", "unverified"), (2, "js", "js", "published"), (3, "x", None, "unverified")], "claim_id long, surface string, skill_id string, state string")
    yes = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "claim_id long, accept boolean")
    assert [tuple(r) for r in review.accepted_aliases(claims, yes).collect()] == [("golang", "go")]
    assert values(spark, ["ac:go", "other", None], review.skill_of) == ["go", None, None]


def test_files(spark, tmp_path):
    (tmp_path / "data").mkdir()
    (tmp_path / "data" / "skills.jsonl").write_text('{"id":"go","name":"Go","aliases":["golang"]}\n{"id":"c","name":"C"}\n{"id":"","name":"x"}\n')
    (tmp_path / "data" / "aliases.jsonl").write_text('{"skill_id":"go","surface":"golang"}\n{"skill_id":"go","surface":"GoLang"}\n')
    got = {r.id: r.surfaces for r in files.read_vocabulary(spark, str(tmp_path), "0.1").collect()}
    assert got == {"go": ["Go", "golang", "GoLang"], "c": ["C"]}
    assert files.read_vocabulary(spark, str(tmp_path / "none"), "0.1").count() == 0
    (tmp_path / "moka.jsonl").write_text('{"a":1,"posted_at":"2024-01-02"}\n{"a":2,"posted_at":"soon"}\n{"a":3,"posted_at":"2020-01-02"}\n')
    path = files.slice_path(spark, str(tmp_path), "moka")
    assert sorted(r.a for r in files.since(files.read_rows(spark, path), "posted_at", "2023-01-01").collect()) == [1, 2]
    (tmp_path / "boards.txt").write_text("# boards\nacme\tAcme Inc\n\nsolo\n")
    assert [tuple(r) for r in files.read_lists(spark, str(tmp_path / "boards.txt")).collect()] == [("acme", "Acme Inc"), ("solo", "solo")]


def near_copies(spark):
    """Lines of one source, a text each: variants of a few, so that many pairs lie around a similarity of 0.8."""
    r = random.Random(3)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for base in range(12):
        line = r.sample(words, 14)
        for k in range(15):
            changed = [r.choice(words) if r.random() < 0.08 else w for w in line]
            rows.append((100 * base + k, "s", " ".join(changed)))
    g = {t: {t[i : i + 3] for i in range(len(t) - 2)} for _, _, t in rows}
    want = {t for t in g for u in g if t != u and len(g[t] & g[u]) >= 0.8 * len(g[t] | g[u])}
    return spark.createDataFrame(rows, "doc_id long, source string, text string"), want


def test_near_blocks_of_tiles_and_of_late_blocks(spark, monkeypatch):
    docs, want = near_copies(spark)
    assert 20 < len(want) < docs.count() - 20
    assert {r.block for r in text.near_blocks(docs, "source").collect()} == want
    monkeypatch.setattr(text, "NEAREST", 1)  # blocks whose nearest one is not alike look for the others later
    monkeypatch.setattr(text, "TILE", 5000)
    monkeypatch.setattr(text, "MAX_SENT", 10)
    got = [r.block for r in text.near_blocks(docs, "source").collect()]
    assert set(got) == want and len(got) == len(want)


def test_blocks_that_are_not_alike_make_no_pairs(spark):
    r = random.Random(5)
    parts = ["tion", "the ", "er", "ing ", "and", "on ", "re", "st", "ed ", "ou"]
    docs = spark.createDataFrame([(i, "s", "".join(r.choice(parts) for _ in range(90))) for i in range(1500)], "doc_id long, source string, text string")
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert text.near_blocks(docs, "source").count() < 10
    assert written() - before < 2_000_000


def test_spans_of_peers_shuffle_little(spark):
    r = random.Random(7)
    parts = ["tion", "the ", "er", "ing ", "and", "on ", "re", "st", "ed ", "ou"]
    docs = spark.createDataFrame([(i, "s", "".join(r.choice(parts) for _ in range(90)) + "\nsaid by two of them" * (i < 2)) for i in range(1000)], "doc_id long, source string, text string")
    written = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    spans = {x.doc_id: x.spans for x in text.boilerplate(docs, "source").collect()}
    assert len(spans) == 1000 and spans[0] and spans[1] and sum(map(bool, spans.values())) < 20
    assert written() - before < 2_000_000
