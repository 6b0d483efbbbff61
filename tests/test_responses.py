"""The data source of stored responses against the boards' own readers, its filter and its partitions."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

from tempograph.sources import boards, responses

AT = "2024-01-01T00:00:00"


def store(folder, rows, per_file=2):
    """Files of stored responses (asked, body, status)."""
    folder.mkdir()
    lines = [json.dumps({"seq": i, "url": f"u{i}", "fetched_at": AT, "status": status, "asked": asked, "body": body}) for i, (asked, body, status) in enumerate(rows)]
    for k in range(0, len(lines), per_file):
        (folder / f"part-{k}.txt").write_text("\n".join(lines[k : k + per_file]) + "\n")
    (folder / "_SUCCESS").write_text("")
    return str(folder)


def frame(spark, rows, names, last=", status int"):
    data = [(*asked.values(), body, status, f"u{i}", AT) for i, (asked, body, status) in enumerate(rows)]
    return spark.createDataFrame(data, f"{names}, body string, status int, url string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


def same(a, b):
    key = lambda df: sorted(map(tuple, df.select("id", "source_id", "url", "content_hash", "payload", "fetched_at").collect()))
    assert key(a) == key(b) and a.count()


def test_boards_with_tokens(spark, tmp_path):
    token = {"token": "t", "name": "T\"é"}
    jobs = {"greenhouse": ({"updated_at": "2024-02-01", "absolute_url": "a"}, {"first_published": "2020-01-01"}, {"updated_at": "", "first_published": "2024-03-01T1"}, {"updated_at": "soon"}), "lever": ({"createdAt": 1709596800000}, {"createdAt": 1}, {"createdAt": "x"}), "ashby": ({"publishedAt": "2024-02-01", "jobUrl": ""}, {"publishedAt": "2023-02-01"}, {})}
    for board, listed in jobs.items():
        listed = [j | {"id": i, "bossName": "B"} for i, j in enumerate(listed)]
        body = json.dumps([*listed, 5, "x"] if board == "lever" else {"jobs": [*listed, 5, None]})
        rows = [(token, body, 200), (token, "no JSON", 200), (token, None, 200), (token, "[]", 200)]
        path = store(tmp_path / board, rows)
        for since in (None, "2024-01-01"):
            same(responses.stored(spark, board, path, since), getattr(boards, board)(frame(spark, rows, "token string, name string"), since))
        assert responses.stored(spark, board, path, "2024-01-01", most=1).count() == 1


def test_lists_and_cards(spark, tmp_path):
    items = json.dumps([{"md5": "1", "s_aae397": "2024-02-01", "aae004": "me"}, {"md5": "2", "s_aae397": "bad", "s_aae395": "2023-01-01"}, {"md5": "3"}, "x"]).replace('"', "&quot;")
    rows = [({"page_no": 1}, f"<input id=findjoblist value=\"{items}\">", 200), ({"page_no": 2}, "<p>none", 200)]
    same(responses.stored(spark, "mohrss", store(tmp_path / "m", rows), "2024-01-01"), boards.mohrss(frame(spark, rows, "page_no int"), "2024-01-01"))
    card = "<a href='/zhaopin/1'>one<br>two</a><span data-job-id='7'>T</span>"
    for k, bad in enumerate((("<p>x</p>", 200), (card, 403), ("滑动验证" + card, 200))):
        rows = [({"page_no": 1}, card, 200), ({"page_no": 2}, *bad), ({"page_no": 3}, card + card, 200)]
        same(responses.stored(spark, "liepin", store(tmp_path / f"l{k}", rows, 1)), boards.liepin(frame(spark, rows, "page_no int")))


def test_a_board_objects_in_the_order_of_asking(spark, tmp_path):
    body = lambda code, *ids: json.dumps({"code": code, "zpData": {"jobList": [{"encryptJobId": i, "salaryDesc": "1-2K"} for i in ids]}})
    asked = lambda k: {"keyword": k, "city": "c", "city_code": "1"}
    path = store(tmp_path / "z", [(asked("z"), body(0, "a"), 200), (asked("b"), body(37, "b"), 200), (asked("a"), body(0, "c"), 200)], 1)
    got = [json.loads(r.payload)["job"]["encryptJobId"] for r in responses.stored(spark, "zhipin", path).collect()]
    assert got == ["a"]  # by the alphabet, keyword a would have come before the halt
    hidden = store(tmp_path / "h", [(asked("z"), body(0, "a").replace("1-2K", " "), 200)])
    assert responses.stored(spark, "zhipin", hidden).count() == 0


def test_slices(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text("\n".join(['{"ats_type": "moka", "url": "u1", "posted_at": "2024-01-02", "n": NaN}', '{"ats_type": "beisen", "url": "u2"}', '{"url": "", "posted_at": "soon"}', '{"url": "u4", "posted_at": "2020-01-01"}', "[]", ""]))
    got = {r.url: json.loads(r.payload) for r in responses.stored(spark, "jobhive_moka", str(tmp_path / "s.jsonl"), "2023-01-01").collect()}
    assert set(got) == {"u1", None} and got["u1"]["n"] is None


def test_the_reader_takes_the_filter_over(spark, tmp_path):
    token = {"token": "t", "name": "T"}
    path = store(tmp_path / "g", [(token, json.dumps({"jobs": [{"id": i, "updated_at": f"2024-01-{i % 28 + 1:02}"} for i in range(50)]}), 200)] * 9, 3)
    rows = responses.scan(spark, "greenhouse", path, "2024-01-20")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"^\W*(\*\(\d+\) )?Filter ", plan, re.M) and rows.rdd.getNumPartitions() == 3
    assert rows.count() == 9 * sum(i % 28 + 1 >= 20 for i in range(50))
    reader = responses.ResponseReader("greenhouse", path)
    day = datetime.date(2024, 1, 20)
    left = list(reader.pushFilters([GreaterThanOrEqual(("keep_day",), day), EqualTo(("seq",), 1), GreaterThanOrEqual(("seq",), 1)]))
    assert reader.since == day and len(left) == 2


def test_bad_options_and_empty_folders(spark, tmp_path):
    with pytest.raises(Exception, match="no such board"):
        responses.scan(spark, "other", str(tmp_path)).count()
    assert responses.scan(spark, "lever", str(tmp_path / "none")).count() == 0
