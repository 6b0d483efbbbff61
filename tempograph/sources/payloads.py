"""Raw payloads of job boards as postings: fields by source, in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vacancy as v

#: Where each source has a field, paths in order of preference. `job.` is the payload's object `job`, or else the payload.
FIELDS: dict[str, dict[str, list[str]]] = {
    "mohrss": {"native": ["md5"], "title": ["acb22a"], "company": ["aab004"], "city": ["area_"], "published": ["s_aae395"], "updated": ["s_aae397"], "occupation": ["aca111"], "low": ["acb241"], "high": ["acb242"]},
    "moka": {"native": ["job.id"], "title": ["job.title"], "company": ["org_name", "job.orgId", "org_id"], "city": ["job.locations[0].city"], "published": ["job.openedAt", "job.publishedAt"], "updated": ["job.updatedAt"], "html": ["job.description"], "low": ["job.minSalary"], "high": ["job.maxSalary"]},
    "greenhouse": {"native": ["job.id"], "title": ["job.title"], "company": ["job.company_name", "board_name"], "city": ["job.location.name"], "published": ["job.first_published"], "updated": ["job.updated_at"], "escaped": ["job.content"]},
    "lever": {"native": ["job.id"], "title": ["job.text", "job.title"], "company": ["board_name", "board_token"], "city": ["job.categories.location"], "epoch": ["job.createdAt"], "html": ["job.description"], "plain": ["job.descriptionPlain"], "low": ["job.salaryRange.min"], "high": ["job.salaryRange.max"]},
    "ashby": {"native": ["job.id"], "title": ["job.title"], "company": ["board_name", "board_token"], "city": ["job.address.postalAddress.addressLocality", "job.address.postalAddress.addressRegion", "job.location"], "published": ["job.publishedAt"], "html": ["job.descriptionHtml"], "plain": ["job.descriptionPlain"]},
    "zhipin": {"native": ["job.encryptJobId"], "title": ["job.jobName", "job.title"], "company": ["job.brandName", "company"], "city": ["job.cityName", "city"], "epoch": ["job.lastModifyTime"], "html": ["job.postDescription", "job.description"], "range": ["job.salaryDesc"]},
    "jobhive": {"native": ["ats_id"], "title": ["title"], "company": ["company"], "city": ["location"], "published": ["posted_at"], "plain": ["description"], "low": ["salary_min"], "high": ["salary_max"], "summary": ["salary_summary"]},
    "liepin": {"title": ["title"], "company": ["company"], "city": ["city"], "published": ["published_at"], "plain": ["text"]},
}
SAME = {"jobhive_beisen": "jobhive", "jobhive_moka": "jobhive"}
THOUSANDS = ["moka", "jobhive"]
COMPONENTS = "array<struct<compensationType: string, minValue: string, maxValue: string>>"


def _field(kind: Column, payload: Column, job: Column, name: str) -> Column:
    """The first path with something in it, of the row's source."""
    out = None
    for source, fields in FIELDS.items():
        if name in fields:
            found = F.coalesce(*[F.nullif(F.get_json_object(job if p.startswith("job.") else payload, "$." + p.removeprefix("job.")), F.lit("")) for p in fields[name]])
            out = F.when(kind == source, found) if out is None else out.when(kind == source, found)
    return out


def to_postings(snapshots: DataFrame) -> DataFrame:
    """Postings of snapshots (id, source_id, content_hash, payload as JSON text); other sources are read as liepin.

    posting_id is the source and the native id, else 32 characters of the hash. A payload that is no JSON gives nulls. Personal
    data in descriptions and titles is redacted.
    """
    source, payload = F.col("source_id"), F.col("payload")
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ({k: k for k in FIELDS if k != "jobhive"} | SAME).items() for x in kv]), source), F.lit("liepin"))
    inner = F.get_json_object(payload, "$.job")
    names = sorted({n for f in FIELDS.values() for n in f})
    s = snapshots.select("id", "source_id", "content_hash", "payload", kind.alias("_kind"), F.when(inner.startswith("{"), inner).otherwise(payload).alias("_job"))
    parts = F.flatten(F.array_compact(F.array(*[F.from_json(F.get_json_object("_job", p), COMPONENTS) for p in ("$.compensation.summaryComponents", "$.compensation.compensationTiers[*].components[*]")])))
    pay = F.get(F.filter(parts, lambda c: c["compensationType"] == "Salary"), 0)
    s = s.select("*", *[_field(F.col("_kind"), F.col("payload"), F.col("_job"), n).alias(n) for n in names], F.when(F.col("_kind") == "ashby", pay).alias("_pay"))
    low, high = (F.coalesce(v.whole_number(F.col(c)), v.whole_number(F.col("_pay")[m])) for c, m in (("low", "minValue"), ("high", "maxValue")))
    thousands = F.col("_kind").isin(THOUSANDS)
    stated = F.struct(*[F.when(thousands, v.in_full(x)).otherwise(x).alias(n) for x, n in ((low, "low"), (high, "high"))])
    salary = F.when(low.isNotNull() | high.isNotNull(), stated).when(F.col("_kind") == "zhipin", v.salary_range(F.col("range"))).when(F.col("_kind") == "jobhive", v.salary_summary(F.col("summary")))
    body = F.coalesce(tx.html_text(F.coalesce("html", tx.unescape("escaped"))), "plain")
    title = F.coalesce("title", F.when(F.col("_kind") == "liepin", F.coalesce(F.nullif(F.substring(tx.redact(F.col("plain")), 1, 80), F.lit("")), F.lit("未命名"))), F.lit(""))
    native = F.coalesce("native", F.substring("content_hash", 1, 32))
    return s.select(F.concat_ws(":", "source_id", native).alias("posting_id"), "source_id", F.col("id").alias("snapshot_id"), tx.redact(title).alias("title"), F.trim("company").alias("company"), F.trim("city").alias("city"), F.coalesce(v.day_of(F.col("published")), v.day_of_epoch(F.col("epoch"))).alias("published_at"), v.day_of(F.col("updated")).alias("updated_at"), tx.redact(body).alias("description"), F.col("occupation").alias("occupation_code"), salary["low"].alias("salary_min"), salary["high"].alias("salary_max"))
