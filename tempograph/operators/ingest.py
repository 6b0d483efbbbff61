"""From snapshots to postings, evidence, observations and the graph's tables; sinks that insert, upsert and replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import period_of
from ..sources import payloads
from ..sources.shared import at_most, kept


def _first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_place = 1").drop("_place")


def append_new(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """existing and of the incoming rows those whose key is new, the first of each; what is there is never changed."""
    return existing.unionByName(_first(incoming, key, order).join(existing.select(*key).distinct(), key, "left_anti").select(existing.columns))


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """existing, with rows of a key that comes in replaced by the first of the incoming ones."""
    new = _first(incoming, key, order).select(existing.columns)
    return existing.join(new.select(*key), key, "left_anti").select(existing.columns).unionByName(new)


def replace_edges(edges: DataFrame, touched: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Edges, with all of the touched ids (key) taken away and the new ones put in: links of an upserted node are replaced, not added."""
    return edges.join(touched.select(key).distinct(), key, "left_anti").select(edges.columns).unionByName(new.select(edges.columns).distinct())


def known(rows: DataFrame, existing: DataFrame, column: str = "content_hash") -> DataFrame:
    """The rows whose hash is there, of whatever source."""
    return rows.join(existing.select(column).distinct(), column, "left_semi")


def anchor(df: DataFrame | None = None) -> Column:
    return F.coalesce("published_at", "updated_at")


def with_keys(postings: DataFrame) -> DataFrame:
    """postings as they are stored: with title_normalized and period, which is null without a day."""
    return postings.withColumns({"title_normalized": tx.normalize_title("title"), "period": period_of(anchor())})


def canonical(postings: DataFrame) -> DataFrame:
    return postings.where("duplicate_of is null").orderBy(F.asc_nulls_last("published_at"), "posting_id")


def totals(postings: DataFrame) -> DataFrame:
    """n_postings with duplicates, n_canonical without."""
    return postings.agg(F.count("*").alias("n_postings"), F.count_if(F.col("duplicate_of").isNull()).alias("n_canonical"))


def to_postings(snapshots: DataFrame, existing: DataFrame | None = None, peers: bool = True) -> DataFrame:
    """Postings of snapshots with boilerplate_spans and duplicate_of; existing ones (canonical and not) are what peers and duplicates
    are looked for in, too. Arrival order is fetched_at, if there, then id.

    posting_id is text, so rows are numbered by arrival for the duplicate test. Peers are postings of one company.
    """
    mapped = payloads.to_postings(snapshots)
    time = snapshots.select(F.col("id").alias("snapshot_id"), (F.col("fetched_at") if "fetched_at" in snapshots.columns else F.lit(None).cast("timestamp")).alias("_time")).dropDuplicates(["snapshot_id"])
    new = mapped.join(time, "snapshot_id", "left").withColumn("_new", F.lit(True))
    every = new
    if existing is not None:
        old = existing.select(*[c for c in mapped.columns if c in existing.columns], "duplicate_of").where("duplicate_of is null").drop("duplicate_of")
        if not peers:  # of other blocks none is a duplicate's first; of blocks without a city none is compared
            old = old.join(mapped.select("company", "city").distinct(), ["company", "city"], "left_semi").select(old.columns)
        every = new.unionByName(old.withColumns({"_new": F.lit(False), "_time": F.lit(None).cast("timestamp")}), allowMissingColumns=True)
    every = kept(every.withColumn("_row", F.xxhash64("posting_id", "snapshot_id", "_new")))
    order = F.struct(F.col("_new"), F.col("_time").isNotNull(), "_time", "posting_id", "snapshot_id").alias("_order")
    rows = every.select(F.col("_row").alias("posting_id"), anchor().alias("day"), "company", "city", "title", order)
    found = tx.greedy_duplicates(rows, ["company", "city"], order=("_order",)).select(F.col("posting_id").alias("_row"), F.col("duplicate_of").alias("_of"))
    names = every.select(F.col("_row").alias("_of"), F.col("posting_id").alias("duplicate_of"))
    spans = tx.boilerplate(every.select(F.col("_row").alias("doc_id"), "company", F.col("description").alias("text")), "company", peers).select(F.col("doc_id").alias("_row"), F.col("spans").alias("boilerplate_spans"))
    out = every.where("_new").join(found, "_row", "left").join(names, "_of", "left").join(spans, "_row", "left")
    return with_keys(out.select(*mapped.columns, "boilerplate_spans", "duplicate_of"))


#: Brackets and what is in them, and all from the first dash on, say nothing about a role.
BRACKETS, TAIL = r"【[^】]*】|\[[^\]]*\]|（[^）]*）|\([^)]*\)", r"[-—–].+$"


def plain_title(title: Column) -> Column:
    bare = F.btrim(F.regexp_replace(F.regexp_replace(title, BRACKETS, ""), TAIL, ""), F.lit(tx.BLANKS))
    return F.when(bare == "", title).otherwise(bare)


def role_id(title: Column) -> Column:
    """role. and ten digits of the hash of the plain title's key; null where nothing is left."""
    key = tx.normalize_title(plain_title(title))
    return F.when(key != "", F.concat(F.lit("role."), F.substring(F.sha1(key.cast("binary")), 1, 10)))


def extract(postings: DataFrame, vocabulary: DataFrame, fallback_period: str, version: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evidence, observations and roles (role_id, name) of canonical postings, by the first mention of each skill in each posting.

    vocabulary is (id, name, surfaces), a dictionary; ambiguous aliases are left out, of a surface of several skills the first keeps it.
    Postings without a day fall into the fallback period; those without text don't count.
    """
    forms = vocabulary.select("id", "name", F.posexplode("surfaces").alias("place", "surface")).where(~tx.too_ambiguous(F.col("surface"), F.col("name")))
    of = forms.groupBy("surface").agg(F.min_by("id", F.struct("id", "place")).alias("id"))
    skill_of = {r.surface: r.id for r in at_most(of, tx.MAX_SURFACES, "surfaces").collect()}
    p = canonical(postings).withColumns({"role_id": role_id(F.col("title")), "at": F.coalesce(period_of(anchor()), F.lit(fallback_period))}).where("role_id is not null")
    shown = F.btrim(plain_title(F.col("title")))
    order = F.struct(F.col("published_at").isNull(), "published_at", "posting_id")
    roles = p.groupBy("role_id").agg(F.min_by(shown, order).alias("name"))
    docs = kept(p.where("description <> ''").select(F.xxhash64("posting_id").alias("doc_id"), "posting_id", "source_id", "role_id", F.col("at").alias("period"), F.col("description").alias("text")))
    hits = tx.scan(docs, skill_of).groupBy("doc_id", "skill_id").agg(F.min(F.struct("start", "end", "surface")).alias("h"))
    found = kept(hits.join(docs.drop("text"), "doc_id").select("posting_id", "source_id", "role_id", "period", "skill_id", "h.*"))
    evidence = found.select(F.concat_ws(".", F.lit("ev"), "posting_id", "skill_id", F.col("start").cast("string")).alias("evidence_id"), "source_id", "posting_id", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("surface").alias("quote"), F.concat(F.lit("ac:"), "skill_id").alias("extractor"), F.lit(0.9).alias("confidence"))
    total = docs.groupBy("role_id", "period").agg(F.count_distinct("posting_id").alias("total_postings"))
    n = found.groupBy("role_id", "period", "skill_id").agg(F.count_distinct("posting_id").alias("posting_count"))
    obs = n.join(total, ["role_id", "period"]).select("role_id", "skill_id", "period", (F.col("posting_count") / F.col("total_postings")).alias("weight"), "posting_count", "total_postings", F.lit(version).alias("ontology_version"))
    return evidence, obs, roles


def graph_tables(observations: DataFrame, roles: DataFrame, skills: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """role (role_id, name, state), skill (skill_id, name), requires: the tables of the graph; unknown names are the ids."""
    o = observations.where("role_id is not null and role_id <> ''")
    r = o.select("role_id").distinct().join(roles, "role_id", "left").select("role_id", F.coalesce("name", "role_id").alias("name"), F.lit("published").alias("state"))
    s = o.select("skill_id").distinct().join(skills.select(F.col("id").alias("skill_id"), "name"), "skill_id", "left").select("skill_id", F.coalesce("name", "skill_id").alias("name"))
    return r, s, o


def put_observations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Observations by role, skill, period and version, of which the incoming row holds; a null role is the global one."""
    key = ["_role", "skill_id", "period", "ontology_version"]
    named = lambda df: df.withColumn("_role", F.coalesce("role_id", F.lit("")))
    return upsert(named(existing), named(incoming).dropDuplicates(), key, [F.desc("posting_count"), F.desc("total_postings")]).drop("_role")


def collect(sources: dict[str, DataFrame], snapshots: DataFrame, postings: DataFrame, today: str, only: str | None = None, most: int | None = None, peers: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """snapshots, postings and a report (source_id, saved, postings) after collecting from sources (name -> snapshots).

    Duplicates and peers are looked for among postings of this quarter and the one before. Snapshots that are known are materialised
    again, as a run may have ended between the two. most bounds new snapshots of all sources together.
    """
    period = F.lit(today).cast("date")
    recent = [period_of(period), period_of(F.add_months(period, -3))]
    report = None
    saved = 0
    for name, batch in sources.items():
        if (only and name != only) or (most is not None and saved >= most):
            continue
        batch = batch.dropDuplicates(["source_id", "content_hash"])
        fresh = batch.join(snapshots.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")
        if most is not None:
            fresh = kept(fresh.orderBy("fetched_at", "id").limit(most - saved))
            batch = fresh.unionByName(batch.join(snapshots.select("source_id", "content_hash"), ["source_id", "content_hash"], "left_semi").select(fresh.columns))
        batch = kept(batch)
        existing = postings.where(F.col("period").isin(*recent)) if postings.columns else postings
        made = kept(to_postings(batch, existing, peers))
        line = fresh.agg(F.lit(name).alias("source_id"), F.count("*").alias("saved")).crossJoin(made.agg(F.count("*").alias("postings")))
        line = kept(line)
        report = line if report is None else report.unionByName(line)
        saved += line.first()["saved"]
        snapshots = kept(append_new(snapshots, batch, ["source_id", "content_hash"], [F.col("fetched_at"), F.col("id")]))
        postings = kept(upsert(postings, made, ["posting_id"], [F.col("snapshot_id")]))
    return snapshots, postings, report


def run_pipeline(snapshots: DataFrame, postings: DataFrame, vocabulary: DataFrame, fallback_period: str, version: str) -> dict[str, DataFrame]:
    """postings (made of the snapshots only where there are none), evidence, observations, role, skill, requires."""
    if postings.isEmpty():
        postings = kept(to_postings(snapshots, peers=False))
    evidence, obs, roles = extract(postings, vocabulary, fallback_period, version)
    obs = kept(obs)
    role, skill, requires = graph_tables(obs, roles, vocabulary)
    return {"postings": postings, "evidence": evidence, "observations": obs, "role": role, "skill": skill, "requires": requires}
