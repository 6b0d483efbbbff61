"""Building a vocabulary: skills with aliases from several lists, clusters, and catalogues of occupations.

Claims on surfaces are settled by `evaluate.claimed_aliases`; a build is held against `evaluate.ontology_errors` afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evaluate

#: Groups of occupations that count as information technology.
TECHNICAL = [
    "2-02-07", "2-02-09", "2-02-10", "2-02-38", "4-04-01", "4-04-02", "4-04-03", "4-04-04", "4-04-05", "4-04-99",
    "6-25-01", "6-25-02", "6-25-03", "6-25-04", "6-25-99", "6-31-07", "2-06-14", "4-01-06", "4-12-02",
]


def language_aliases(files: DataFrame) -> DataFrame:
    """name, place, alias of YAML texts (value: a whole file) of languages; place and alias are null for a name without aliases.

    Names are lines that begin in the first column and end in a colon; aliases are the items below a line `aliases:`. Comments and
    blank lines count for nothing. A name that comes twice has the aliases of its last place.
    """
    lines = files.select(F.xxhash64("value").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    lines = lines.where(~F.col("line").startswith("#") & ~F.trim("line").isin("", "---"))
    bare, name = F.trim("line"), ~F.col("line").startswith(" ") & F.col("line").endswith(":")
    item = bare.startswith("- ")
    key = F.col("line").startswith("  ") & ~F.col("line").startswith("    ") & F.col("line").contains(":") & ~item
    before = Window.partitionBy("file").orderBy("at")
    lines = lines.withColumn("head", F.max(F.when(name, F.struct("at", F.expr("substr(line, 1, length(line) - 1)").alias("name")))).over(before))
    lines = lines.withColumn("listed", F.last(F.when(name, False).when(bare == "aliases:", True).when(key, False), ignorenulls=True).over(before))
    alias = F.regexp_replace(F.trim(F.expr("substr(trim(line), 3)")), "^['\"]+|['\"]+$", "")
    found = lines.where("head is not null").select("file", "head", "at", F.when(F.col("listed") & item & (alias != ""), alias).alias("alias"))
    last = found.groupBy("file", "head").agg(F.sort_array(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("at", "alias")))).alias("items"))
    kept = last.groupBy(F.col("head.name").alias("name")).agg(F.max_by("items", F.struct("file", "head.at")).alias("items"))
    return kept.select("name", F.posexplode_outer(F.col("items.alias")).alias("place", "alias"))


def examples_of(rows: DataFrame) -> DataFrame:
    """name, hot, n, place of rows (name, hot_technology, place): whether any row of a name is hot, its rows, and the first place."""
    named = rows.withColumn("name", F.trim("name")).where("name <> ''")
    hot = F.coalesce(F.max(F.col("hot_technology") == "Y"), F.lit(False))
    return named.groupBy("name").agg(hot.alias("hot"), F.count("*").alias("n"), F.min("place").alias("place"))


def _step(step: int, text, source: str, index=None) -> Column:
    at = F.lit(step), F.lit(0) if index is None else index
    return F.struct(at[0].alias("step"), at[1].cast("int").alias("i"), text.alias("text"), F.lit(source).alias("source"))


def _hits(skills: DataFrame, examples: DataFrame) -> DataFrame:
    """slug, hit, hot: the example of the first name of a skill that is one, written alike before another case, then in their order."""
    names = F.concat(F.array("name_en", "name_zh"), F.coalesce("extra", F.array().cast("array<string>")))
    asked = skills.select("slug", F.posexplode(names).alias("i", "asked")).where("asked <> ''")
    met = asked.join(examples.withColumn("folded", F.lower("name")), F.lower("asked") == F.col("folded"))
    return met.groupBy("slug").agg(F.min(F.struct("i", (F.col("asked") != F.col("name")).alias("other_case"), "place", "name", "hot")).alias("h")).select("slug", F.col("h.name").alias("hit"), "h.hot")


def build_skills(skills: DataFrame, languages: DataFrame, examples: DataFrame, more: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Skills (slug, name_zh, name_en, extra, parent, cluster_id, direction, language) as vocabulary rows, and the table of aliases.

    languages is of `language_aliases`, examples of `examples_of`, more has (slug, place, alias). A skill claims, in order, its name, its
    English name, extra names, the English name in lower case, aliases of its language (language, or else the English name), the example it
    hits, and more; skills claim by slug, and the first claim on a folded surface holds. A skill's aliases are the texts it holds but its
    name, each once, in order of its claims. A skill whose texts are all held by others has an empty array.
    """
    spoken = languages.groupBy("name").agg(F.sort_array(F.collect_list(F.when(F.col("alias").isNotNull(), F.struct("place", "alias")))).alias("spoken"))
    added = more.groupBy("slug").agg(F.sort_array(F.collect_list(F.struct("place", "alias"))).alias("added"))
    s = skills.withColumn("_language", F.coalesce("language", "name_en"))
    s = s.join(spoken.withColumnRenamed("name", "_language"), "_language", "left").join(_hits(skills, examples), "slug", "left").join(added, "slug", "left")
    none = F.array().cast("array<struct<step:int,i:int,text:string,source:string>>")
    listed = lambda step, items, source, text: F.coalesce(F.transform(items, lambda x, i: _step(step, text(x), source, i)), none)
    steps = F.concat(
        F.array(_step(0, F.col("name_zh"), "curated")),
        F.when(F.col("name_en") != F.col("name_zh"), F.array(_step(1, F.col("name_en"), "curated"))).otherwise(none),
        listed(2, F.filter("extra", lambda x: x != ""), "curated", lambda x: x),
        F.when(F.lower("name_en") != F.col("name_zh"), F.array(_step(3, F.lower("name_en"), "curated"))).otherwise(none),
        listed(4, F.col("spoken"), "linguist", lambda x: x["alias"]),
        F.when(F.col("hit").isNotNull(), F.array(_step(5, F.col("hit"), "onet"))).otherwise(none),
        listed(6, F.col("added"), "llm", lambda x: x["alias"]),
    )
    skill_id = F.concat(F.lit("skill."), "slug")
    claims = s.select("slug", skill_id.alias("skill_id"), F.explode(steps).alias("c")).select("slug", "skill_id", "c.*")
    held = evaluate.claimed_aliases(claims.select(F.col("text").alias("surface"), "skill_id", "source", F.struct("slug", "step", "i").alias("place")))
    folded = F.lower(F.btrim(F.regexp_replace("text", r"\s+", " ")))
    own = claims.withColumn("surface_folded", folded).join(held.select("surface_folded", "skill_id"), ["surface_folded", "skill_id"], "left_semi")
    own = own.join(skills.select("slug", "name_zh"), "slug").where("text <> name_zh")
    first = own.groupBy("skill_id", "text").agg(F.min(F.struct("step", "i", "text", "source")).alias("f"))
    kept = first.groupBy("skill_id").agg(F.sort_array(F.collect_list("f")).alias("kept"))
    rows = s.withColumn("id", skill_id).join(kept.withColumnRenamed("skill_id", "id"), "id", "left")
    known = F.col("spoken").isNotNull()
    external = F.map_filter(F.create_map(F.lit("linguist"), F.when(known, F.col("_language")), F.lit("onet"), F.col("hit"), F.lit("onet_hot"), F.when(F.col("hot"), F.lit("Y"))), lambda _, v: v.isNotNull())
    by_model = F.exists(F.coalesce("kept", none), lambda x: x["source"] == "llm")
    sources = F.array_compact(F.array(F.lit("curated"), F.when(known, F.lit("linguist")), F.when(F.col("hit").isNotNull(), F.lit("onet")), F.when(by_model, F.lit("llm"))))
    built = rows.select(
        "id", F.col("name_zh").alias("name"), "name_zh", "name_en", F.coalesce(F.col("kept.text"), F.array().cast("array<string>")).alias("aliases"),
        F.when(F.col("parent") != "", F.concat(F.lit("skill."), "parent")).alias("parent_id"), "cluster_id", "direction",
        sources.alias("sources"), external.alias("external_ids"), F.lit(version).alias("ontology_version"),
    )
    return built, held.withColumn("ontology_version", F.lit(version))


def build_clusters(clusters: DataFrame, skills: DataFrame, version: str) -> DataFrame:
    """Clusters (id, name, name_en, direction) with the ascending ids of their skills (id, cluster_id); none is an empty array."""
    of = skills.groupBy(F.col("cluster_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("skill_ids"))
    return clusters.join(of, "id", "left").select("id", "name", "name_en", "direction", F.coalesce("skill_ids", F.array().cast("array<string>")).alias("skill_ids"), F.lit(version).alias("ontology_version"))


def is_technical(code: Column) -> Column:
    return F.coalesce(F.regexp_extract(code, r"^[^-]*-[^-]*-[^-]*", 0).isin(TECHNICAL), F.lit(False))


def occupation_rows(rows: DataFrame, fixes: DataFrame, version: str, source: str) -> DataFrame:
    """Rows (level, code, name, gbm, parent_code, is_digital, is_green) of a classification as catalogue rows.

    Level is major, mid, small, occupation or job_type. The parent is the code without its last part, but a job type names its own.
    fixes (code, name, is_digital, is_green) replace values of occupations. Groups and occupations that aren't technical are placeholders.
    """
    fixed = fixes.select("code", F.lit("occupation").alias("level"), F.struct("name", "is_digital", "is_green").alias("fix"))
    r = rows.join(fixed, ["code", "level"], "left")
    value = lambda c: F.when(F.col("fix").isNotNull(), F.col("fix")[c]).otherwise(F.col(c))
    flagged = lambda c: F.col("level").isin("occupation", "job_type") & F.coalesce(value(c), F.lit(False))
    parent = F.when(F.col("level") == "job_type", F.col("parent_code")).when(F.col("code").contains("-") & (F.col("level") != "major"), F.regexp_replace("code", "-[^-]*$", ""))
    technical = is_technical(F.col("code"))
    return r.select(
        F.concat(F.lit("occ."), "code").alias("id"), "code", F.when(F.col("level").isin("major", "mid", "small"), F.col("gbm")).alias("gbm"), value("name").alias("name"), "level",
        parent.alias("parent_code"), flagged("is_digital").alias("is_digital"), flagged("is_green").alias("is_green"), technical.alias("is_it_related"),
        (F.col("level").isin("small", "occupation") & ~technical).alias("is_placeholder"), F.lit(version).alias("ontology_version"), F.lit(source).alias("source"),
    )


def new_occupation_rows(batches: DataFrame, version: str) -> DataFrame:
    """A row for each occupation and job type (arrays of names) of the batches (batch, ...); other columns of a batch go to its rows."""
    other = [c for c in batches.columns if c not in ("batch", "occupations", "job_types")]
    none = F.array().cast("array<string>")
    of = lambda c, kind: F.transform(F.coalesce(c, none), lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    rows = batches.select("batch", *other, F.explode(F.concat(of("occupations", "occupation"), of("job_types", "job_type"))).alias("o"))
    number = F.lpad(F.col("batch").cast("string"), 2, "0")
    number = F.when(F.col("batch") < 100, number).otherwise(F.col("batch").cast("string"))
    rows = rows.select("batch", *other, "o.name", "o.kind")
    return rows.select(F.concat(F.lit("newocc."), number, F.when(F.col("kind") == "job_type", F.lit(".job.")).otherwise(F.lit(".")), "name").alias("id"), "name", "kind", "batch", *other, F.lit(version).alias("ontology_version"))
