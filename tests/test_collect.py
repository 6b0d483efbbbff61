"""Collecting as a stream: runs that end and go on, replays, caps, halts and duplicates."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tempograph.operators import ingest
from tempograph.sources import boards, responses
from tempograph.sources.shared import shared_folder
from tempograph.streaming import collect

AT = "2024-03-01T00:00:00"


def write(folder, pages, first=0):
    """A file a page of greenhouse jobs, in order of their times."""
    os.makedirs(folder, exist_ok=True)
    for i, jobs in enumerate(pages, first):
        path = f"{folder}/f{i:03}.txt"
        body = jobs if isinstance(jobs, str) else json.dumps({"jobs": jobs})
        with open(path, "w") as f:
            f.write(json.dumps({"seq": i, "url": f"u{i}", "fetched_at": AT, "status": 200, "asked": {"token": "t", "name": "T"}, "body": body}) + "\n")
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


def job(i, title=None, day="2024-02-10"):
    return {"id": i, "title": title or f"Title {i} {chr(97 + i % 26) * 6}", "company_name": "C", "location": {"name": "X"}, "first_published": day}


def run(spark, source, to, **how):
    return collect.collect(spark, how.pop("board", "greenhouse"), source, to, today="2024-03-01", peers=False, **how)


def content(to):
    return sorted(r.payload for r in to.snapshots().select("payload").collect()), sorted(tuple(r) for r in to.postings().select("posting_id", "title", "duplicate_of").collect())


@pytest.fixture
def to(spark):
    return collect.Store(spark, shared_folder(spark))


def test_a_run_that_ends_and_goes_on_gives_the_rows_of_one(spark, to, tmp_path):
    pages = [[job(1), job(2)], [job(2), job(3)], [job(4, "Title 1 bbbbbb")], [job(5)], [job(6, "Title 5 ffffff")]]
    source = write(f"{tmp_path}/in", pages)
    whole = collect.Store(spark, shared_folder(spark))
    assert run(spark, source, whole) == "ok"
    assert run(spark, source, to, flushes=2) == "interrupted" and to.ledger().count() == 2
    # What a flush leaves that ended before its ledger row isn't seen, and goes.
    to.snapshots().limit(1).withColumn("payload", F.lit("junk")).write.parquet(f"{to.folder}/snapshots/batch=2")
    assert content(to)[0] == sorted(content(to)[0]) and "junk" not in content(to)[0]
    assert run(spark, source, to, flushes=1) == "interrupted"
    assert run(spark, source, to) == "ok"
    assert content(to) == content(whole) and to.ledger().count() == 5
    assert sum(r.saved for r in to.ledger().collect()) == to.snapshots().count() == 6
    assert {r.posting_id: r.duplicate_of for r in to.postings().collect()} == {f"greenhouse:{i}": {4: "greenhouse:1", 6: "greenhouse:5"}.get(i) for i in range(1, 7)}
    assert run(spark, source, to) == "ok" and to.ledger().count() == 5
    write(source, [[job(7)]], 9)
    assert run(spark, source, to) == "ok" and to.snapshots().count() == 7


def test_a_store_without_its_checkpoint_saves_nothing_twice(spark, to, tmp_path):
    source = write(f"{tmp_path}/in", [[job(1)], [job(2)]])
    run(spark, source, to, files=2)
    shutil.rmtree(f"{to.folder}/checkpoint")
    shutil.rmtree(f"{to.folder}/ledger/flush=0")
    assert to.snapshots().count() == 0 and run(spark, source, to, files=2) == "ok"
    assert to.snapshots().count() == 2 and to.postings().count() == 2


def test_most_bounds_all_runs(spark, to, tmp_path):
    source = write(f"{tmp_path}/in", [[job(i) for i in range(k, k + 3)] for k in (0, 3, 6)])
    run(spark, source, to, most=4, flushes=1)
    assert run(spark, source, to, most=4) == "ok" and to.snapshots().count() == to.postings().count() == 4


def test_a_board_that_objects_ends_collecting(spark, to, tmp_path):
    card = lambda i: f"<a href='/zhaopin/{i}'>Card {i}</a>"
    source = write(f"{tmp_path}/in", [card(0), card(1), "<p>captcha</p>" + card(2), card(3)])
    assert run(spark, source, to, board="liepin") == "halted"
    assert sorted(json.loads(p)["text"] for p in content(to)[0]) == ["Card 0", "Card 1"] and to.postings().count() == 2
    assert [r.state for r in to.ledger().orderBy("batch").collect()] == ["ok", "ok", "halted"]
    assert run(spark, source, to, board="liepin") == "halted" and to.snapshots().count() == 2


def test_files_without_vacancies(spark, to, tmp_path):
    assert run(spark, write(f"{tmp_path}/in", ["no JSON", []]), to, files=2) == "ok" and to.snapshots().count() == to.postings().count() == 0
    with pytest.raises(Exception, match="not collected"):
        run(spark, write(f"{tmp_path}/other", [[job(1)]]), collect.Store(spark, shared_folder(spark)), board="moka")


def test_pages_after_an_objection_are_not_parsed(spark, tmp_path, monkeypatch):
    parsed = spark.sparkContext.accumulator(0)
    cards = boards._cards

    @F.pandas_udf("array<struct<href:string,text:string>>")
    def counted(s):
        parsed.add(len(s))
        return s.map(cards)

    monkeypatch.setattr(boards, "job_cards", counted)
    rows = spark.range(50).select(F.col("id").alias("seq"), F.lit("u").alias("url"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"), F.when(F.col("id") == 5, 403).otherwise(200).alias("status"), F.struct(F.lit("x").alias("page_no")).alias("asked"), F.concat(F.lit('<a href="/zhaopin/'), F.col("id").cast("string"), F.lit('">A</a>')).alias("body"))
    to = collect.Store(spark, str(tmp_path / "to"))
    assert collect.collect(spark, "liepin", responses.write(rows, str(tmp_path / "in"), 1), to, today="2024-04-01", peers=False) == "halted"
    assert to.snapshots().count() == 5 and parsed.value == 5


def test_known_postings_of_other_blocks_are_left(spark, monkeypatch):
    def snapshots(jobs):
        rows = [(f"g:{i}", "greenhouse", None, "u", f"h{i}", json.dumps({"board_name": "T", "job": {**job(i, "Cook of soups"), "location": {"name": city}}})) for i, city in jobs]
        return spark.createDataFrame(rows, collect.SNAPSHOTS)

    old = collect.kept(ingest.to_postings(snapshots([(i, f"city {i}") for i in range(20)]), peers=False))
    counts, keep = [], ingest.kept
    monkeypatch.setattr(ingest, "kept", lambda df: counts.append(df.count()) or keep(df))
    made = ingest.to_postings(snapshots([(100, "city 7"), (101, "elsewhere")]), old, peers=False)
    assert {r.posting_id: r.duplicate_of for r in made.collect()} == {"greenhouse:100": "greenhouse:7", "greenhouse:101": None}
    assert counts == [3]
