"""Stored responses of job boards as snapshots: one row a vacancy, with its payload in canonical JSON and the hash of it.

Nothing is fetched: responses are tables (body and what was asked for), replayed as often as needed. Limits are by order of the
responses and of the vacancies in them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vacancy as v

#: Keys that hold names or numbers of persons; they and what is under them never reach a payload.
PERSONAL_KEYS = ["aae004", "aae005", "jobManager", "jobHrAssistant", "jobHiringManager", "jobInterviewer", "bossName", "bossInfo"]
#: Fields that a payload keeps of a listed vacancy, and of its details.
LISTED = ["encryptJobId", "encryptBrandId", "lid", "jobName", "salaryDesc", "jobExperience", "jobDegree", "cityName", "areaDistrict", "businessDistrict", "brandName", "brandScaleName", "brandStageName", "brandIndustry", "jobLabels", "skills", "welfareList", "lastModifyTime"]
DETAILED = ["postDescription", "showSkills", "address", "locationName", "experienceName", "degreeName"]


def without_keys(value, keys: frozenset):
    """A JSON value without these keys, at any depth."""
    if isinstance(value, dict):
        return {k: without_keys(x, keys) for k, x in value.items() if k not in keys}
    return [without_keys(x, keys) for x in value] if isinstance(value, list) else value


def _canonical(text: str | None) -> str | None:
    try:
        value = json.loads(text) if text is not None else None
    except ValueError:
        return None
    return json.dumps(without_keys(value, frozenset(PERSONAL_KEYS)), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """The object without personal keys, its keys sorted, without blanks; null for what is no JSON object."""
    return s.map(_canonical)


def content_hash(payload: Column) -> Column:
    return F.sha2(canonical_json(payload), 256)


def as_snapshots(rows: DataFrame, source: str, most: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """id, source_id, fetched_at, url, content_hash, payload of rows (url, fetched_at, raw); rows that are no object go, and those beyond most."""
    s = rows.withColumn("payload", canonical_json("raw")).where("payload is not null")
    if most is not None:
        s = s.orderBy(*(order or [F.col("url")])).limit(most)
    s = s.withColumn("content_hash", F.sha2("payload", 256))
    return s.select(F.concat_ws(":", F.lit(source), "content_hash").alias("id"), F.lit(source).alias("source_id"), "fetched_at", "url", "content_hash", "payload")


def _quoted(c: str) -> Column:
    """A JSON string, or null, of a column."""
    return F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))


def wrapped(**fields: Column) -> Column:
    """A JSON object of fields that are JSON already."""
    parts = [F.concat(F.lit(f'"{k}":'), c) for k, c in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def vacancies(responses: DataFrame, array: Column) -> DataFrame:
    """responses with place and job: the objects of an array of JSON text."""
    rows = responses.select("*", F.posexplode(F.from_json(array, "array<string>")).alias("place", "job"))
    return rows.where(F.col("job").startswith("{"))


def not_before(day: Column, since: str | None) -> Column:
    return F.lit(True) if since is None else day.isNull() | (day >= F.lit(since).cast("date"))


def _field(path: str) -> Column:
    return F.nullif(F.get_json_object("job", path), F.lit(""))


def _board(source: str, array: Callable[[], Column], day: Callable[[], Column], link: str) -> Callable:
    def read(responses: DataFrame, since: str | None = None, most: int | None = None) -> DataFrame:
        r = vacancies(responses, array()).where(not_before(day(), since))
        raw = wrapped(board_token=_quoted("token"), board_name=_quoted("name"), job=F.col("job"))
        rows = r.select(F.coalesce(_field(link), "url").alias("url"), "fetched_at", raw.alias("raw"), "token", "place")
        return as_snapshots(rows, source, most, [F.col("token"), F.col("place")])

    read.__doc__ = f"Snapshots of {source} responses (token, name, url, fetched_at, body), from a day on; vacancies without a day stay."
    return read


_jobs = lambda: F.get_json_object("body", "$.jobs")
greenhouse = _board("greenhouse", _jobs, lambda: v.day_of(F.coalesce(_field("$.updated_at"), _field("$.first_published"))), "$.absolute_url")
lever = _board("lever", lambda: F.col("body"), lambda: v.day_of_epoch(_field("$.createdAt")), "$.hostedUrl")
ashby = _board("ashby", _jobs, lambda: v.day_of(_field("$.publishedAt")), "$.jobUrl")


def moka(responses: DataFrame, per_org: int | None = 40, most: int | None = None, modes: tuple[str, ...] = ("social", "campus")) -> DataFrame:
    """Snapshots of responses (org_id, org_name, mode, offset, url, fetched_at, body); of each organisation the first per_org vacancies."""
    mode = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
    r = vacancies(responses.where(F.col("mode").isin(*modes)), _jobs())
    order = [mode, F.col("offset"), F.col("place")]
    if per_org is not None:
        r = r.withColumn("_n", F.row_number().over(Window.partitionBy("org_id").orderBy(*order))).where(F.col("_n") <= per_org)
    raw = wrapped(org_id=_quoted("org_id"), org_name=_quoted("org_name"), mode=_quoted("mode"), job=F.col("job"))
    rows = r.select(F.concat("url", F.lit("?mode="), "mode").alias("url"), "fetched_at", raw.alias("raw"), "org_id", mode.alias("_mode"), "offset", "place")
    return as_snapshots(rows, "moka", most, [F.col("org_id"), F.col("_mode"), F.col("offset"), F.col("place")])


class _Inputs(HTMLParser):
    """The value of the input of an id."""

    def __init__(self, wanted: str) -> None:
        super().__init__(convert_charrefs=True)
        self.wanted, self.value = wanted, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "input" and a.get("id") == self.wanted and self.value is None:
            self.value = a.get("value") or ""


def _input_value(page: str | None, wanted: str) -> str | None:
    p = _Inputs(wanted)
    p.feed(page or "")
    p.close()
    return p.value


@F.pandas_udf(T.StringType())
def hidden_list(s: pd.Series) -> pd.Series:
    return s.map(lambda page: _input_value(page, "findjoblist"))


def mohrss(responses: DataFrame, since: str | None = None, most: int | None = None) -> DataFrame:
    """Snapshots of pages (page_no, url, fetched_at, body) that hold their list in a hidden input."""
    r = vacancies(responses, hidden_list("body"))
    r = r.where(not_before(F.coalesce(v.day_of(_field("$.s_aae397")), v.day_of(_field("$.s_aae395"))), since))
    return as_snapshots(r.select("url", "fetched_at", F.col("job").alias("raw"), "page_no", "place"), "mohrss", most, [F.col("page_no"), F.col("place")])


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Cards(HTMLParser):
    """Elements that are cards: links to vacancies, elements of the class job-card or with data-job-id; with the texts inside."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None]] = []
        self.cards: list[dict] = []

    def handle_starttag(self, tag, attrs):
        a = {k: x or "" for k, x in attrs}
        own, href = "data-job-id" in a or "job-card" in a.get("class", "").split(), a.get("href", "")
        linked = tag == "a" and "/zhaopin/" in href
        card = {"href": href, "texts": []} if (linked or own) and "?" not in href and (not href or "/zhaopin/" in href or own) else None
        if card:
            self.cards.append(card)
        if tag not in _VOID:
            self.open.append((tag, card))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for _, card in self.open:
            if card is not None:
                card["texts"].append(data)


def _cards(page: str | None) -> list[dict]:
    p = _Cards()
    p.feed(page or "")
    p.close()
    found = [{"href": c["href"], "text": " ".join(" ".join(c["texts"]).split())} for c in p.cards]
    return [c for c in found if c["text"]]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("href", T.StringType()), T.StructField("text", T.StringType())])))
def job_cards(s: pd.Series) -> pd.Series:
    return s.map(_cards)


def until_halt(responses: DataFrame, bad: Column, order: list[str]) -> DataFrame:
    """The responses before the first bad one: a board that objects is not asked again."""
    first = responses.where(bad).agg(F.min(F.struct(*order)).alias("_halt"))
    return responses.join(F.broadcast(first), F.lit(True)).where(F.col("_halt").isNull() | (F.struct(*order) < F.col("_halt"))).drop("_halt")  # one row


#: What pages say that ask for a proof of being human.
CAPTCHA = ["验证码", "geetest", "captcha", "滑动验证", "人机验证"]


def objects(body: Column, status: Column) -> Column:
    """Whether a response is an error, or asks for a proof of being human."""
    return (F.coalesce(status, F.lit(200)) >= 400) | F.exists(F.array(*map(F.lit, CAPTCHA)), lambda m: F.contains(F.lower(body), m))


def liepin(responses: DataFrame, most: int | None = None) -> DataFrame:
    """Snapshots of the cards of pages (page_no, status, url, fetched_at, body), up to the first that objects or has no card."""
    return liepin_cards(with_cards(until_halt(responses, objects(F.col("body"), F.col("status")), ["page_no"])), most)


def with_cards(responses: DataFrame) -> DataFrame:
    """page_no, url, fetched_at, cards of pages that do not object."""
    return responses.select("page_no", "url", "fetched_at", job_cards("body").alias("cards"))


def liepin_cards(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Snapshots of pages with their cards, up to the first without one."""
    r = until_halt(pages, F.size("cards") == 0, ["page_no"]).select("page_no", "url", "fetched_at", F.posexplode("cards").alias("place", "card"))
    href = F.coalesce(F.nullif(F.col("card.href"), F.lit("")), F.col("url"))
    return as_snapshots(r.select(href.alias("url"), "fetched_at", F.to_json(F.struct(href.alias("href"), F.col("card.text").alias("text"))).alias("raw"), "page_no", "place"), "liepin", most, [F.col("page_no"), F.col("place")])


def _merged(job: str, detail: str | None) -> str:
    full = lambda src, keys: {k: src[k] for k in keys if src.get(k) not in (None, "")}
    try:
        info = json.loads(detail or "{}")["zpData"]["jobInfo"]
    except (ValueError, KeyError, TypeError):
        info = {}
    more = full(info, DETAILED) if isinstance(info, dict) else {}
    out = more | full(json.loads(job), LISTED)
    if "postDescription" in more:
        out["description"] = more["postDescription"]
    return json.dumps(out, ensure_ascii=False)


@F.pandas_udf(T.StringType())
def merged_job(job: pd.Series, detail: pd.Series) -> pd.Series:
    return pd.Series([_merged(j, d) for j, d in zip(job, detail)])


def zhipin(lists: DataFrame, details: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Snapshots of lists (keyword, city, city_code, page, status, url, fetched_at, body) and details (job_id, body), up to the first
    list that objects. Lists without any salary were not logged in, and give nothing."""
    code = F.coalesce(F.get_json_object("body", "$.code"), F.lit("0"))
    ok = until_halt(lists, objects(F.col("body"), F.col("status")) | F.ltrim("body").startswith("<") | (code != "0"), ["keyword", "city", "page"])
    r = vacancies(ok, F.get_json_object("body", "$.zpData.jobList")).withColumn("job_id", _field("$.encryptJobId"))
    shown = r.agg(F.max(F.coalesce(F.trim(_field("$.salaryDesc")), F.lit("")) != "").alias("_shown"))
    r = r.join(F.broadcast(shown), F.lit(True)).where("_shown").drop("_shown")  # one row
    d = details.select("job_id", F.col("body").alias("detail")).dropDuplicates(["job_id"]) if details is not None else None
    r = r.join(d, "job_id", "left") if d is not None else r.withColumn("detail", F.lit(None).cast("string"))
    raw = wrapped(keyword=_quoted("keyword"), city=_quoted("city"), city_code=_quoted("city_code"), job=merged_job("job", "detail"))
    return as_snapshots(r.select("url", "fetched_at", raw.alias("raw"), "keyword", "city", "page", "place"), "zhipin", most, [F.col(c) for c in ("keyword", "city", "page", "place")])


def jobhive(rows: DataFrame, board: str, since: str | None = None, most: int | None = None) -> DataFrame:
    """Snapshots of a slice's rows of one board (beisen or moka); NaN is null."""
    if board not in ("beisen", "moka"):
        raise ValueError(f"neither beisen nor moka: {board}")
    kind = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("ats_type", "_slice") if c in rows.columns], F.lit(board))
    r = rows.where(kind == board)
    if "posted_at" in r.columns:
        r = r.where(not_before(v.day_of(F.col("posted_at").cast("string")), since))
    clean = [F.nanvl(c, F.lit(None)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in r.dtypes]
    url = F.nullif(F.col("url"), F.lit("")) if "url" in r.columns else F.lit(None).cast("string")
    return as_snapshots(r.select(url.alias("url"), F.current_timestamp().alias("fetched_at"), F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("raw")), f"jobhive_{board}", most, [F.col("raw")])


def merge_lists(lists: list[DataFrame]) -> DataFrame:
    """token, name of several lists (token, name): of each token the name of the first list that has it, sorted."""
    every = None
    for i, one in enumerate(lists):
        rows = one.select("token", "name").withColumns({"_list": F.lit(i), "_row": F.monotonically_increasing_id()})
        every = rows if every is None else every.unionByName(rows)
    return every.groupBy("token").agg(F.min_by("name", F.struct("_list", "_row")).alias("name")).orderBy("token")
