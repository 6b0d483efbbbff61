"""Claims and their evidence: verdicts, decisions, provenance, the change log, and how much of it can be traced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdicts that a reviewer may give; any other counts as the last.
VERDICTS = ["supported", "unsupported", "uncertain"]


def verdicts(reviews: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, verdict, cited: reviews (claim_id, verdict, cited) with known verdicts and only ids of the claim's own evidence, in order.

    The ids of one claim's evidence meet in a row; evidence is (claim_id, evidence_id).
    """
    own = evidence.groupBy("claim_id").agg(F.collect_set("evidence_id").alias("allowed"))
    none = F.array().cast(reviews.schema["cited"].dataType)
    cited = F.coalesce(F.filter("cited", lambda i: F.coalesce(F.array_contains(F.coalesce(F.col("allowed"), none), i), F.lit(False))), none)
    verdict = F.when(F.col("verdict").isin(VERDICTS), F.col("verdict")).otherwise(VERDICTS[-1])
    return reviews.join(own, "claim_id", "left").select("claim_id", verdict.alias("verdict"), cited.alias("cited"))


def decide(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """Claims (claim_id, state) with the state that decisions (claim_id, accept) give to those not yet verified."""
    d = F.when(F.col("accept"), "published").otherwise("rejected")
    open_ = (F.col("state") == "unverified") & F.col("accept").isNotNull()
    return claims.join(decisions.select("claim_id", "accept"), "claim_id", "left").withColumn("state", F.when(open_, d).otherwise(F.col("state"))).drop("accept")


def accepted_aliases(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """surface, skill_id of open claims (claim_id, surface, skill_id, state) that a decision accepts as aliases."""
    return claims.where("state = 'unverified'").join(decisions.where("accept").select("claim_id"), "claim_id", "left_semi").where("skill_id is not null and surface is not null").select("surface", "skill_id").distinct()


def provenance(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_id, place and the evidence row of each id in claims (claim_id, evidence_ids), in the claim's order."""
    ids = claims.select("claim_id", F.posexplode("evidence_ids").alias("place", "evidence_id"))
    return ids.join(evidence, "evidence_id")


def rolled_back(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The change log with the entries of `ids` (change_id) marked as rolled back."""
    hit = ids.select("change_id").distinct().withColumn("_hit", F.lit(True))
    return log.join(hit, "change_id", "left").withColumn("rolled_back", F.coalesce("_hit", F.col("rolled_back"))).drop("_hit")


def skill_of(extractor: Column) -> Column:
    """The skill that a scan's extractor names, else null."""
    return F.nullif(F.regexp_extract(extractor, "^ac:(.+)$", 1), F.lit(""))


def same_text(a: Column, b: Column) -> Column:
    return (a == b) | (F.lower(a) == F.lower(b))


def fragment(text: Column, start: Column, end: Column) -> Column:
    return F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of boxes (x0, y0, x1, y1) as arrays; 0 without one."""
    side = lambda lo, hi: F.greatest(F.least(F.get(a, hi), F.get(b, hi)) - F.greatest(F.get(a, lo), F.get(b, lo)), F.lit(0.0))
    area = lambda x: (F.get(x, 2) - F.get(x, 0)) * (F.get(x, 3) - F.get(x, 1))
    common = side(0, 2) * side(1, 3)
    union = area(a) + area(b) - common
    return F.coalesce(F.when(union > 0, common / union), F.lit(0.0))


def trace_flags(pred: DataFrame, gold: DataFrame, docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, name, span_ok, box_ok, quote_ok, traced of names in both tables (doc_id, name, start, end, surface, box)."""
    g = gold.select("doc_id", "name", F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("box").alias("gb"))
    j = pred.join(g, ["doc_id", "name"]).join(docs.select("doc_id", "text"), "doc_id", "left")
    span = F.col("start").eqNullSafe(F.col("gs")) & F.col("end").eqNullSafe(F.col("ge"))
    box = F.col("gb").isNull() | (box_iou(F.col("box"), F.col("gb")) >= least)
    quote = F.col("start").isNull() | F.col("end").isNull() | same_text(fragment(F.coalesce("text", F.lit("")), F.col("start"), F.col("end")), F.coalesce("surface", "name"))
    r = j.select("doc_id", "name", span.alias("span_ok"), box.alias("box_ok"), quote.alias("quote_ok"))
    return r.withColumn("traced", F.col("span_ok") & F.col("box_ok") & F.col("quote_ok"))


def traceable(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """evidence (doc_id, start, end, quote and more) with traced 1 or 0: its span reads as its quote; without a quote or a text the span is enough."""
    there = F.col("start").isNotNull() & (F.col("text").isNull() | F.col("quote").isNull() | same_text(fragment(F.col("text"), F.col("start"), F.col("end")), F.col("quote")))
    e = evidence.join(docs.select("doc_id", "text"), "doc_id", "left")
    return e.withColumn("traced", F.coalesce(there, F.lit(False)).cast("int")).drop("text")


def claim_rates(claims: DataFrame, evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """n_claims, traceable_rate, multi_source_rate of claims (claim_id), by evidence (claim_id, doc_id, source_id, start, end, quote)."""
    e = traceable(evidence, docs).groupBy("claim_id").agg(F.max("traced").alias("t"), (F.count_distinct("source_id") >= 2).cast("int").alias("m"))
    rate = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(0))), F.lit(0.0))
    return claims.select("claim_id").join(e, "claim_id", "left").agg(F.count("*").alias("n_claims"), rate("t").alias("traceable_rate"), rate("m").alias("multi_source_rate"))


def field_accuracy(gold: DataFrame, pred: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """field, n, accuracy, and a row `micro` over all: the share of gold rows whose prediction agrees; a missing prediction is wrong."""
    p = pred.select(key, F.lit(True).alias("_there"), *[F.col(f).alias(f"_{f}") for f in fields])
    j = gold.join(p, key, "left")
    hits = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col("_there").isNotNull() & F.col(f).eqNullSafe(F.col(f"_{f}"))).cast("int").alias("hit")) for f in fields])).alias("h")
    return j.select(hits).select("h.*").rollup("field").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy")).withColumn("field", F.coalesce("field", F.lit("micro")))


def with_overrides(inferred: DataFrame, manual: DataFrame) -> DataFrame:
    """src, dst, rule, confidence, active, locked: inferred edges, replaced or joined by manual ones (src, dst, active), which stay locked."""
    m = manual.select("src", "dst", F.lit("manual").alias("rule"), F.lit(1.0).alias("confidence"), "active", F.lit(True).alias("locked"))
    rest = inferred.join(m.select("src", "dst"), ["src", "dst"], "left_anti")
    return rest.select("src", "dst", "rule", "confidence", F.lit(True).alias("active"), F.lit(False).alias("locked")).unionByName(m)


def text_lines(docs: DataFrame, most: int = 80) -> DataFrame:
    """doc_id, line, text, y: the first lines of each text as a page shows them."""
    lines = docs.select("doc_id", F.posexplode(F.slice(F.split(F.coalesce("text", F.lit("")), "\n"), 1, most)).alias("line", "text"))
    return lines.withColumn("y", F.least(F.lit(0.96), 0.04 + F.col("line") * 0.035))


def evidence_details(ids: DataFrame, evidence: DataFrame, documents: DataFrame, most: int = 80) -> DataFrame:
    """place, evidence_id, source_id, skill_id, doc_id, kind, text, lines of the evidence asked for (place, evidence_id), in the order of asking.

    evidence is (evidence_id, source_id, doc_id, quote, extractor), documents (doc_id, kind, text); evidence that isn't there gives no
    row. Without its document the quote is the text, of kind posting. lines are those of the first page (text, y).
    """
    found = ids.select("place", "evidence_id").join(evidence, "evidence_id").join(documents.select("doc_id", "kind", "text"), "doc_id", "left")
    text = F.coalesce("text", "quote")
    line = lambda x, i: F.struct(x.alias("text"), F.least(F.lit(0.96), 0.04 + i * 0.035).alias("y"))
    lines = F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, most), line)
    named = F.coalesce(F.col("doc_id").cast("string"), "evidence_id").alias("doc_id")
    return found.select("place", "evidence_id", "source_id", skill_of(F.col("extractor")).alias("skill_id"), named, F.coalesce("kind", F.lit("posting")).alias("kind"), text.alias("text"), lines.alias("lines")).orderBy("place")
