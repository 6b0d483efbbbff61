"""Collecting from stored responses as a stream: flushes by files, a ledger that makes replays harmless, halts that keep what was flushed.

Each micro-batch is a flush. It writes its snapshots and postings as partitions of their own (batch=n, overwritten if the batch comes
again) and then one row of the ledger, which is what makes them count: readers take the batches that the ledger has, so what a
flush has left that ended before its ledger row is not seen, and is overwritten by its replay. A batch that the ledger has already is
not run again. When a board objects, the vacancies asked for before stay, the ledger says so, and later batches are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ingest
from ..schema import period_of
from ..sources import boards, responses
from ..sources.shared import kept

SNAPSHOTS = "id string, source_id string, fetched_at timestamp, url string, content_hash string, payload string"
LEDGER = "batch long, saved long, postings long, state string"
RESPONSE = "seq long, url string, fetched_at timestamp, status int, asked string, body string"


class Interrupted(Exception):
    """A run that was to end after so many flushes."""


class Store:
    """The folder of a collecting run: snapshots, postings, ledger and the stream's checkpoint."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def ledger(self) -> DataFrame:
        """A row a flush: what it has saved, how many postings it has written, and ok or halted."""
        return self._read("ledger", LEDGER)

    def _counted(self, name: str, schema: str) -> DataFrame:
        counted = [r.batch for r in self.ledger().select("batch").collect()]  # a row a flush; others' files are not read, as a replay may write them
        return self._read(name, f"{schema}, batch long").where(F.col("batch").isin(counted))

    def snapshots(self) -> DataFrame:
        """The snapshots of flushes that count."""
        return self._counted("snapshots", SNAPSHOTS).drop("batch")

    def postings(self) -> DataFrame:
        """The last version of each posting of flushes that count."""
        found = self._counted("postings", _posting_schema(self.spark))
        place = F.row_number().over(Window.partitionBy("posting_id").orderBy(F.desc("batch"), "snapshot_id"))
        return found.withColumn("_place", place).where("_place = 1").drop("_place", "batch")


def _posting_schema(spark: SparkSession) -> str:
    empty = spark.createDataFrame([], SNAPSHOTS)
    made = ingest.with_keys(ingest.payloads.to_postings(empty)).withColumns({"boilerplate_spans": F.lit(None).cast("array<struct<start:int,end:int>>"), "duplicate_of": F.lit(None).cast("string")})
    return ", ".join(f"`{n}` {t}" for n, t in made.dtypes)


def _snapshots(board: str, batch: DataFrame, since: str | None) -> tuple[DataFrame, bool]:
    """The snapshots of a batch of responses before the first by which the board objects, and whether there is one."""
    asked = lambda n: F.get_json_object("asked", f"$.{n}").alias(n)
    if board in ("greenhouse", "lever", "ashby"):
        return getattr(boards, board)(batch.select("*", asked("token"), asked("name")), since), False
    if board == "mohrss":
        return boards.mohrss(batch.withColumn("page_no", F.col("seq")), since), False
    if board == "liepin":
        rows = batch.withColumn("page_no", F.col("seq"))
        said = boards.objects(F.col("body"), F.col("status"))
        asked_for = boards.until_halt(rows, said, ["page_no"])  # what comes after an open objection is not read by Python
        cards = kept(boards.with_cards(asked_for))
        return boards.liepin_cards(cards), not (rows.where(said).isEmpty() and cards.where(F.size("cards") == 0).isEmpty())
    raise ValueError(f"not collected as a stream: {board}")


def collect(spark: SparkSession, board: str, source: str, store: Store, since: str | None = None, most: int | None = None, files: int = 1, today: str | None = None, peers: bool = True, flushes: int | None = None) -> str:
    """Collect what is new in a folder of stored responses into a store; ok or halted.

    files is how many stored files a flush takes. most bounds the snapshots saved by all runs into the store. Duplicates and peers are
    looked for among postings of today's quarter and the one before. flushes ends the run by an error after so many, before the stream
    has noted the last one: a run that goes on replays it.
    """
    day = F.to_date(F.lit(today)) if today else F.current_date()
    recent = [period_of(day), period_of(F.add_months(day, -3))]
    done = 0

    def flush(batch: DataFrame, number: int) -> None:
        nonlocal done
        ledger = {r.batch: r for r in store.ledger().collect()}  # a row a flush
        if number in ledger or any(r.state == "halted" for r in ledger.values()):
            return
        saved = sum(r.saved for r in ledger.values())
        made, halted = _snapshots(board, kept(batch.repartition("seq")), since)  # a stored file is read by one task, its pages are parsed by many
        made = kept(made.dropDuplicates(["source_id", "content_hash"]))
        key = ["source_id", "content_hash"]
        fresh = made.join(store.snapshots().select(*key), key, "left_anti").select(made.columns)
        if most is not None:
            fresh = kept(fresh.orderBy("fetched_at", "url", "id").limit(max(0, most - saved)))
        seen = made.join(store.snapshots().select(*key), key, "left_semi").select(made.columns)  # a run may have ended between the two
        fresh.write.mode("overwrite").parquet(f"{store.folder}/snapshots/batch={number}")
        written = spark.read.schema(fresh.schema).parquet(f"{store.folder}/snapshots/batch={number}")
        n = written.count()
        batch = kept(written.unionByName(seen))
        own = ingest.payloads.to_postings(batch).select("posting_id").distinct()  # not to be found as duplicates of themselves
        known = store.postings().where(F.col("period").isin(*recent)).join(own, "posting_id", "left_anti")
        postings = kept(ingest.to_postings(batch, known, peers))
        postings.write.mode("overwrite").parquet(f"{store.folder}/postings/batch={number}")
        row = spark.createDataFrame([(number, n, postings.count(), "halted" if halted else "ok")], LEDGER)
        row.coalesce(1).write.mode("overwrite").parquet(f"{store.folder}/ledger/flush={number}")
        done += 1
        if flushes is not None and done >= flushes:
            raise Interrupted(f"ended after {done} flushes")

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(responses.ROWS))  # a row may be a page of many vacancies
    lines = spark.readStream.option("maxFilesPerTrigger", files).text(source)
    rows = lines.select(F.from_json("value", RESPONSE, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]"}).alias("r")).select("r.*")
    query = rows.writeStream.foreachBatch(flush).option("checkpointLocation", f"{store.folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception as e:
        if "Interrupted" not in str(e):
            raise
        return "interrupted"
    return "halted" if not store.ledger().where("state = 'halted'").isEmpty() else "ok"
