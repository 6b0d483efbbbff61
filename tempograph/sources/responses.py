"""Stored responses of job boards as a data source: `spark.read.format("board_responses").option("board", ...)`.

A stored file has a response a line, as JSON: seq (the order of asking), url, fetched_at, status, asked (what was asked for) and body;
for slices (board jobhive_...) a line is a row itself. Each file is a partition. A row of the source is a vacancy:

    seq, place, url, fetched_at, asked, job (JSON), day, keep_day, objects

keep_day is the day a vacancy is to be kept from on: its day, or the last day there is where it has none or none that can be read. A
filter `keep_day >= since` is taken over by the reader, so vacancies before it never leave the worker. A response by which a board
objects (an error, a request for a proof of being human, a page without cards) is one row with objects = true and without a job.
Lines that are no JSON object, and vacancies that aren't, give no rows; an empty folder gives none. Files are read through
Arrow's file systems, so the folder may be in any store that these reach from the workers.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThanOrEqual, InputPartition, IsNotNull

from . import boards

FORMAT, SCHEMA = "board_responses", "seq long, place int, url string, fetched_at timestamp, asked string, job string, day date, keep_day date, objects boolean"
LAST_DAY = datetime.date(9999, 12, 31)
#: Rows of an Arrow batch.
ROWS = 1000


def _day(text) -> datetime.date | None:
    """The ISO day that a text begins with."""
    head = str(text)[:10] if text not in (None, "") else ""
    try:
        return datetime.date.fromisoformat(head) if len(head) == 10 and head[4] == head[7] == "-" else None
    except ValueError:
        return None


def _epoch_day(number) -> datetime.date | None:
    """The UTC day of a number of seconds, or of milliseconds if above 1e10."""
    try:
        n = float(number)
        return datetime.date(1970, 1, 1) + datetime.timedelta(days=(n / 1000 if n > 1e10 else n) // 86400)
    except (TypeError, ValueError, OverflowError):
        return None


def _loads(text: str | None):
    try:
        return json.loads(text, parse_constant=lambda _: None) if text else None
    except ValueError:
        return None


def _under(value, *keys: str):
    for k in keys:
        value = value.get(k) if isinstance(value, dict) else None
    return value


def _listed(*keys: str):
    return lambda body: _under(_loads(body), *keys) if keys else _loads(body)


def _cards(body: str | None) -> list[dict]:
    return boards._cards(body)


#: By board: the list of vacancies of a body, a vacancy's day, and the field of its link.
READERS = {
    "greenhouse": (_listed("jobs"), lambda j: _day(j.get("updated_at") or j.get("first_published")), "absolute_url"),
    "lever": (_listed(), lambda j: _epoch_day(j.get("createdAt")), "hostedUrl"),
    "ashby": (_listed("jobs"), lambda j: _day(j.get("publishedAt")), "jobUrl"),
    "moka": (_listed("jobs"), lambda j: None, None),
    "mohrss": (lambda body: _loads(boards._input_value(body, "findjoblist")), lambda j: _day(j.get("s_aae397")) or _day(j.get("s_aae395")), None),
    "liepin": (_cards, lambda j: None, "href"),
    "zhipin": (_listed("zpData", "jobList"), lambda j: None, None),
    "zhipin_detail": (lambda body: [body] if body else [], lambda j: None, None),
    "jobhive_moka": (None, lambda j: _day(j.get("posted_at")), "url"),
    "jobhive_beisen": (None, lambda j: _day(j.get("posted_at")), "url"),
}


def _objects(board: str, body: str | None, status) -> bool:
    if board not in ("liepin", "zhipin"):
        return False
    text = body or ""
    if (status or 200) >= 400 or any(m in text.lower() for m in boards.CAPTCHA):
        return True
    if board == "liepin":
        return not _cards(text)
    return text.lstrip().startswith("<") or str(_under(_loads(text), "code") or 0) != "0"


class _File(InputPartition):
    pass


class ResponseReader(DataSourceReader):
    def __init__(self, board: str, path: str) -> None:
        self.board, self.path, self.since = board, path, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThanOrEqual) and f.attribute == ("keep_day",) and isinstance(f.value, datetime.date):
                self.since = max(f.value, self.since or f.value)
            elif not (isinstance(f, IsNotNull) and f.attribute == ("keep_day",)):
                yield f

    def _store(self):
        from pyarrow import fs

        path = self.path.replace("file:///", "/").replace("file:/", "/")
        return fs.FileSystem.from_uri(path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = self._store()
        if store.get_file_info(path).type == fs.FileType.File:
            return [_File(path)]
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        hidden = lambda f: f.base_name.startswith(("_", ".")) or not f.size
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and not hidden(f)]

    def _rows(self, line: dict) -> Iterator[tuple]:
        listed, day_of, link = READERS[self.board]
        sliced = listed is None
        seq, at = (0, None) if sliced else (line.get("seq"), line.get("fetched_at"))
        asked = {} if sliced else line.get("asked") or {}
        stamp = datetime.datetime.fromisoformat(at) if at else None
        stamp = stamp.replace(tzinfo=datetime.UTC) if stamp and stamp.tzinfo is None else stamp
        said = json.dumps(asked, ensure_ascii=False)
        if not sliced and _objects(self.board, line.get("body"), line.get("status")):
            yield seq, -1, line.get("url"), stamp, said, None, None, LAST_DAY, True
            return
        jobs = [line] if sliced else listed(line.get("body"))
        for place, job in enumerate(jobs if isinstance(jobs, list) else []):
            if self.board != "zhipin_detail" and not isinstance(job, dict):
                continue
            day = None if self.board == "zhipin_detail" else day_of(job)
            if self.since is not None and day is not None and day < self.since:
                continue
            text = job if isinstance(job, str) else json.dumps(job, ensure_ascii=False)
            url = (job.get(link) if link else None) or (None if sliced else line.get("url"))
            if self.board == "liepin":
                text = json.dumps({"href": url, "text": job["text"]}, ensure_ascii=False)
            yield seq, place, url, stamp, said, text, day, day or LAST_DAY, False

    def read(self, partition: InputPartition) -> Iterator:
        import io

        import pyarrow as pa

        if partition is None:  # an empty folder
            return
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "date": pa.date32(), "boolean": pa.bool_()}
        store, schema = self._store()[0], pa.schema([(n, kinds[t]) for n, t in (c.split() for c in SCHEMA.split(", "))])
        held: list[tuple] = []
        with store.open_input_stream(partition.value) as raw:
            for text in io.TextIOWrapper(raw, "utf-8"):
                line = _loads(text)
                held += self._rows(line) if isinstance(line, dict) else ()
                if len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in held], schema=schema)


class BoardResponses(DataSource):
    """Options: path (a file or a folder of stored responses) and board (a key of READERS)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ResponseReader:
        board = self.options.get("board")
        if board not in READERS:
            raise ValueError(f"no such board: {board}")
        if not self.options.get("path"):
            raise ValueError("path is missing")
        return ResponseReader(board, self.options["path"])


def write(responses: DataFrame, path: str, files: int = 4) -> str:
    """Store responses (seq, url, fetched_at, status, asked, body), in `files` files by ranges of seq."""
    ranged = responses.repartitionByRange(files, "seq").sortWithinPartitions("seq")
    ranged.select(F.to_json(F.struct("seq", "url", "fetched_at", "status", "asked", "body"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
    return path


def scan(spark: SparkSession, board: str, path: str, since: str | None = None) -> DataFrame:
    """The vacancies of stored responses, from a day on; those without a readable day stay.

    The session is set to hand filters over to Python data sources (spark.sql.python.filterPushdown.enabled).
    """
    spark.dataSource.register(BoardResponses)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format(FORMAT).option("board", board).load(path)
    return rows if since is None else rows.where(F.col("keep_day") >= F.lit(since).cast("date"))


def until_halt(rows: DataFrame) -> DataFrame:
    """The vacancies of the responses asked for before the first by which the board objects, in the order of asking."""
    first = rows.where("objects").agg(F.min("seq").alias("_halt"))
    return rows.join(F.broadcast(first), F.lit(True)).where("not objects and (_halt is null or seq < _halt)").drop("_halt")  # one row


def _asked(name: str) -> Column:
    return F.get_json_object("asked", f"$.{name}")


def _raw(*names: str, job: Column | None = None) -> Column:
    return boards.wrapped(**{n: boards._quoted(n) for n in names}, job=F.col("job") if job is None else job)


def stored(spark: SparkSession, board: str, path: str, since: str | None = None, most: int | None = None, per_org: int | None = None, details: str | None = None, modes: tuple[str, ...] = ("social", "campus")) -> DataFrame:
    """Snapshots of the vacancies of stored responses, of which `most` in the order of asking.

    per_org and modes are for moka: an organisation's first vacancies, by mode and offset. details is a folder of zhipin's details
    (asked.job_id); lists without any salary were not logged in and give nothing.
    """
    rows = until_halt(scan(spark, board, path, since))
    order = [F.col("seq"), F.col("place")]
    if board in ("greenhouse", "lever", "ashby"):
        rows = rows.withColumns({"board_token": _asked("token"), "board_name": _asked("name")}).withColumn("raw", _raw("board_token", "board_name"))
    elif board == "moka":
        rows = rows.withColumns({n: _asked(n) for n in ("org_id", "org_name", "mode")}).where(F.col("mode").isin(*modes))
        mode = F.array_position(F.array(*map(F.lit, modes)), F.col("mode"))
        order = [F.col("org_id"), mode, _asked("offset").cast("long"), F.col("place")]
        if per_org is not None:
            rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("org_id").orderBy(*order))).where(F.col("_n") <= per_org)
        rows = rows.withColumns({"raw": _raw("org_id", "org_name", "mode"), "url": F.concat("url", F.lit("?mode="), "mode")})
    elif board == "zhipin":
        shown = rows.agg(F.max(F.coalesce(F.trim(F.get_json_object("job", "$.salaryDesc")), F.lit("")) != "").alias("_shown"))
        rows = rows.join(F.broadcast(shown), F.lit(True)).where("_shown")  # one row
        rows = rows.withColumns({n: _asked(n) for n in ("keyword", "city", "city_code")}).withColumn("job_id", F.get_json_object("job", "$.encryptJobId"))
        if details:
            more = scan(spark, "zhipin_detail", details).select(_asked("job_id").alias("job_id"), F.col("job").alias("detail"), "seq", "place").where("job_id is not null")
            more = more.groupBy("job_id").agg(F.min_by("detail", F.struct("seq", "place")).alias("detail"))
            rows = rows.join(more, "job_id", "left")
        else:
            rows = rows.withColumn("detail", F.lit(None).cast("string"))
        rows = rows.withColumn("raw", _raw("keyword", "city", "city_code", job=boards.merged_job("job", "detail")))
    else:
        rows = rows.withColumn("raw", F.col("job"))
        if board.startswith("jobhive_"):
            kind = F.coalesce(*[F.nullif(F.get_json_object("job", f"$.{c}"), F.lit("")) for c in ("ats_type", "_slice")], F.lit(board.removeprefix("jobhive_")))
            rows, order = rows.where(kind == board.removeprefix("jobhive_")), [F.col("raw")]
            rows = rows.withColumn("fetched_at", F.current_timestamp())
    return boards.as_snapshots(rows, board, most, order)
