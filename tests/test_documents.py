"""Files of documents, layout, recall and duplicates against plain versions."""

import datetime
import random
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.functions import text
from tempograph.operators import extract, vectors
from tempograph.sources import documents

from .test_kernels import duplicates_by_force


def test_files_of_a_folder(spark, sf, tmp_path):
    texts = {r.doc_id: "".join(c for c in r.text if c >= " " or c in "\t\n") for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()}
    (tmp_path / "sub").mkdir()
    for i, t in texts.items():
        if i % 2:
            (tmp_path / f"{i}.txt").write_bytes(("﻿" if i % 3 else "").encode() + t.encode())
        else:
            lines = [(x, 20.0 if n == 0 else None, n == 1, "Heading1" if n == 2 else None) for n, x in enumerate(t.split("\n"))]
            (tmp_path / "sub" / f"{i}.docx").write_bytes(documents.write_word(lines))
    (tmp_path / "other.png").write_bytes(b"x")
    got = documents.read_documents(spark, str(tmp_path)).collect()
    assert len(got) == len(texts)
    for r in got:
        i = int(r.path.rsplit("/", 1)[1].split(".")[0])
        assert r.error is None and r.text == texts[i] and r.kind == ("plain" if i % 2 else "word")
        if not i % 2:
            lines = texts[i].split("\n")
            assert [r.text[x.start : x.end] for x in r.runs] == [x for x in lines if x]
            assert all((x.size, x.bold, x.style) == (20.0 if x.paragraph == 0 else 10.0, x.paragraph == 1, "Heading1" if x.paragraph == 2 else None) for x in r.runs)


def test_styles_breaks_and_tabs(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    styles = f'<w:styles {w}><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="24"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="A"><w:basedOn w:val="B"/><w:rPr><w:b/></w:rPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:sz w:val="40"/></w:rPr></w:style></w:styles>'
    body = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="A"/></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:rPr><w:b w:val="0"/><w:sz w:val="7"/></w:rPr><w:t>é</w:t></w:r></w:hyperlink></w:p><w:p/><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", styles)
    assert documents.read_word((tmp_path / "x.docx").read_bytes()) == ("a\tb\né\n\nend", [(0, 4, 0, 20.0, True, "A"), (4, 5, 0, 3.5, False, "A"), (7, 10, 2, 12.0, False, None)])


def test_files_that_cannot_be_read(spark, monkeypatch):
    good = documents.write_word([("x" * 5000, None, False, None)])
    empty = documents.write_word([])
    rows = [("a.docx", b"no zip"), ("b.docx", good[: len(good) // 2]), ("c.docx", None), ("d.txt", b"\xff\xfeok"), ("e.txt", None), ("f.docx", empty), ("g.docx", good)]
    got = {r.path: r for r in documents.parsed(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert all(got[f"{x}.docx"].error and got[f"{x}.docx"].text is None for x in "abc") and got["d.txt"].text.endswith("ok") and got["e.txt"].text == "" and got["f.docx"].text == "" and len(got["g.docx"].text) == 5000
    monkeypatch.setattr(documents, "MAX_XML", 1000)
    with pytest.raises(documents.Unreadable, match="over"):
        documents.read_word(good)
    assert documents.parsed(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_titles_leave_no_row(spark):
    lines = [("Head ", 14.0, True, None), ("", None, False, None), ("body one", None, False, None), ("x" * 30, 20.0, False, None), ("body two", None, False, "Heading2"), ("end", None, False, None)]
    files = spark.createDataFrame([("a.docx", bytearray(documents.write_word(lines))), ("b.docx", bytearray(b"none")), ("c.docx", bytearray(documents.write_word([])))], "path string, content binary")
    found = documents.titles(documents.parsed(files))
    assert [(r.path, r.label) for r in found.orderBy("start").collect()] == [("a.docx", "Head"), ("a.docx", "body two")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def page(lines, width=600.0):
    """Characters of lines (x, y, text, size)."""
    return [(1, 0, width, c, x + 6.0 * i, float(y), x + 6.0 * i + 5, y + 10.0, size) for x, y, t, size in lines for i, c in enumerate(t) if c != " "]


CHARS = "doc_id long, page int, page_width double, text string, x0 double, y0 double, x1 double, y1 double, size double"


def gap_by_steps(chars, width):
    """Every step looked at by itself."""
    best = None
    for k in range(200):
        x = width * 0.28 + 4.0 * k
        if x < width * 0.72 and width >= 200 and len(chars) >= 12 and not any(c[4] < x < c[6] for c in chars):
            small = min(sum(c[6] <= x for c in chars), sum(c[6] > x for c in chars))
            if small >= 4 and (best is None or small > best[0]):
                best = small, x
    return best and best[1]


def test_gaps_of_made_pages(spark):
    rng = random.Random(4)
    pages, want = [], {}
    for i in range(60):
        width = rng.choice([150.0, 400.0, 611.0])
        lines = [(rng.choice([10, 20, rng.randrange(int(width))]), rng.randrange(700), "x" * rng.randrange(1, 20), 10.0) for _ in range(rng.randrange(1, 12))]
        chars = [(i, 0, *c[2:]) for c in page(lines, width)]
        pages += chars
        if (g := gap_by_steps(chars, width)) is not None:
            want[i] = g
    got = {r.doc_id: r.gap for r in extract.column_gaps(spark.createDataFrame(pages, CHARS)).collect()}
    assert got == want and 5 < len(want) < 55


def test_marks_titles_and_pages(spark):
    lines = [(20, 700, "Skills", 14.0), (20, 680, "one two, three", 10.0), (20, 660, "x )y", 10.0), (20, 640, "more of it here", 10.0)]
    rows = page(lines) + [(1, 1, *c[2:]) for c in page([(20, 700, "next page", 10.0)])] + [(2, 0, 600.0, "", 1.0, 1.0, 2.0, 2.0, 1.0), (3, 0, 600.0, "k", 1.0, 1.0, 2.0, 2.0, None)]
    layout = extract.page_layout(spark.createDataFrame(rows, CHARS).withColumn("line", F.lit(1)))
    got = {(r.doc_id, r.page): r for r in layout.collect()}
    assert set(got) == {(1, 0), (1, 1), (3, 0)} and got[3, 0].text == "k" and got[3, 0].titles == []
    assert got[1, 0].text == "Skills\none two, three\nx)y\nmore of it here" and [(t.start, t.end, t.label) for t in got[1, 0].titles] == [(0, 6, "Skills")]
    assert [r.start for r in got[1, 0].runs] == list(range(len(got[1, 0].text)))
    whole = {r.doc_id: r for r in extract.joined_pages(layout).collect()}
    assert whole[1].text == got[1, 0].text + "\nnext page" and whole[1].runs[-1].page == 1 and whole[1].text[whole[1].runs[-1].start : whole[1].runs[-1].end] == "e"


def made_pages(spark, seed=5):
    rng = random.Random(seed)
    rows = []
    for doc in range(3):
        for k in range(3):
            lines = [(rng.choice([10, 14, 320]), 700 - 14 * rng.randrange(30), "".join(rng.choice("ab,. ") for _ in range(rng.randrange(1, 25))), rng.choice([10.0, 10.0, 14.0])) for _ in range(20)]
            rows += [(doc, k, *c[2:]) for c in page(lines)]
    return spark.createDataFrame(rows, CHARS)


def test_lines_of_pages_hold_their_own_characters(spark):
    chars = made_pages(spark)
    whole = {(r.doc_id, r.page): r for r in extract.page_layout(chars).collect()}
    lines = extract.page_lines(chars)
    for key, r in whole.items():
        own = sorted((x for x in lines.collect() if (x.doc_id, x.page) == key), key=lambda x: x.line) if key == (0, 0) else None
        if own:
            assert "".join(x.text for x in own) == r.text and [y for x in own for y in x.runs] == r.runs and max(len(x.runs) for x in own) < len(r.runs) / 4
    counts = {(r.doc_id, r.page): (r.text, r.titles, r.n_placed) for r in extract.page_counts(lines).collect()}
    assert counts == {k: (r.text, r.titles, sum(x.end - x.start for x in r.runs)) for k, r in whole.items()} and any(r.titles for r in whole.values())


def test_boxes_of_lines_are_those_of_whole_documents(spark):
    chars = made_pages(spark, 6)
    whole = extract.joined_pages(extract.page_layout(chars))
    spans = [(a, a + n) for a in (0, 3, 50, 200, 500) for n in (1, 4, 90, 900)]
    want = {}
    for a, b in spans:
        for r in whole.select("doc_id", extract.span_geometry(F.lit(a), F.lit(b), F.col("runs")).alias("g")).collect():
            if r.g:
                want[r.doc_id, a, b] = (r.g.page, list(r.g.box))
    asked = spark.createDataFrame([(d, a, b) for d in range(3) for a, b in spans], "doc_id long, start int, end int")
    got = {(r.doc_id, r.start, r.end): (r.page, list(r.box)) for r in extract.line_geometry(extract.joined_lines(extract.page_lines(chars)), asked).collect()}
    assert got == want and len(want) > 40


def test_recall_equals_all_pairs(spark, sf):
    parts = [r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()]
    rng = random.Random(3)
    forms = [(f"s{i % 60:02}", x) for i, x in enumerate(sorted(set(parts)) + ["", " ", "C++", "c", "数据 分析", "分析 数据 开发"] + [x.split()[0] for x in parts[:50]])]
    forms.sort(key=lambda f: f[0].encode())
    of = extract.Recall(forms)
    asked = rng.sample(parts, 20) + ["", "C", "数据分析", "analysis", "x" * 300, parts[0][1:], " ".join(reversed(parts[1].split())), "a a a"]
    for s in asked:
        want = sorted(range(len(forms)), key=lambda i: (-extract.token_set(s, forms[i][1]), i))[:20]
        assert of.best(s, 20) == want, s
    assert extract.Recall([]).best("x", 20) == [] and extract.Recall([("a", "b")]).best("", 5) == [0]


def test_recall_query_equals_all_pairs(spark, sf):
    from tempograph.plans import operations

    forms = [(r.id, f) for r in sorted(operations.brands(spark, sf).collect(), key=lambda r: r.id) for f in r.surfaces]
    got = {}
    for r in operations.recall_candidates(spark, sf).collect():
        got.setdefault(r.surface, {})[r.place] = r.skill_id
    assert len(got) > 10
    for s in sorted(got)[:25]:
        order = sorted(range(len(forms)), key=lambda i: (-extract.token_set(s, forms[i][1]), i))[:20]
        assert [got[s][k] for k in sorted(got[s])] == list(dict.fromkeys(forms[i][0] for i in order))


def test_one_large_block_of_postings(spark):
    rng = random.Random(8)
    day = datetime.date(2024, 1, 1)
    stems = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(6, 25))) for _ in range(300)]
    rows = [(i, day + datetime.timedelta(days=i // 8), "a", "x", (s := rng.choice(stems))[: rng.randrange(len(s) - 2, len(s) + 1)] + rng.choice(["", "", "z"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "posting_id long, day date, company string, city string, title string")
    for order in (("day", "posting_id"), ("posting_id",)):
        got = {r.posting_id: r.duplicate_of for r in text.greedy_duplicates(df, ["company", "city"], order=order).collect()}
        assert got == duplicates_by_force(rows) and sum(v is not None for v in got.values()) > 500


def test_fifty_thousand_rows_of_one_block_end_in_time(spark):
    many = spark.range(50_000).select(F.col("id").alias("posting_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 150).cast("int")).alias("day"), F.lit("a").alias("company"), F.lit("x").alias("city"), F.substring(F.md5((F.col("id") % 9000).cast("string")), 1, 14).alias("title"))
    began = time.time()
    n = text.greedy_duplicates(many, ["company", "city"]).where("duplicate_of is not null").count()
    assert n > 10_000 and time.time() - began < 120


def test_vectors_of_other_lengths_take_no_part(spark):
    rows = [(i, [float(i), 1.0]) for i in range(5)] + [(10, None), (11, [1.0]), (12, [1.0, float("nan")]), (13, [None, 1.0]), (14, []), (15, [float("inf"), 1.0]), (16, [0.0, 0.0]), (17, [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>")
    got = vectors.top_k(df, df.select(F.col("vec_id").alias("query_id"), "e"), 9).collect()
    near = {}
    for r in got:
        near.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(near) == {0, 1, 2, 3, 4, 16, 11, 17} and near[1] == {0, 2, 3, 4, 16} and near[11] == {17} and not any(np.isnan(r.score) for r in got)
