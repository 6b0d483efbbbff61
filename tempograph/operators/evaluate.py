"""Evaluation: agreement, precision and recall, rank measures, samples; grades of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def kappa(rows: DataFrame) -> DataFrame:
    """n, po, pe, kappa of two binary columns a and b."""
    d = lambda c: F.avg(F.col(c).cast("double"))
    r = rows.agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"), d("a").alias("pa"), d("b").alias("pb"))
    r = r.withColumn("pe", F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb")))
    return r.select("n", "po", "pe", F.when(F.col("pe") >= 1, F.when(F.col("po") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def precision_recall(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, tp, fp, fn, precision, recall, f1 of boolean columns gold and pred."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    t = rows.groupBy(*by).agg(n(F.col("gold") & F.col("pred")).alias("tp"), n(~F.col("gold") & F.col("pred")).alias("fp"), n(F.col("gold") & ~F.col("pred")).alias("fn"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select(*by, "tp", "fp", "fn", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def rank_measures(rows: DataFrame, by: str, k: int = 3) -> DataFrame:
    """by, spearman (ranks with ties averaged), ndcg at k, of columns predicted and gold (higher is better) and item."""
    w = Window.partitionBy(by)
    mean_rank = lambda c: F.rank().over(w.orderBy(F.desc(c))) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2
    r = rows.withColumns({"rp": mean_rank("predicted"), "rg": mean_rank("gold"), "place": F.row_number().over(w.orderBy(F.desc("predicted"), "item")), "ideal": F.row_number().over(w.orderBy(F.desc("gold"), "item"))})
    gain = lambda p: F.sum(F.when(F.col(p) <= k, F.col("gold") / F.log2(F.col(p) + 1.0)).otherwise(0.0))
    t = r.groupBy(by).agg(F.covar_pop("rp", "rg").alias("c"), F.count("*").alias("n"), F.stddev_pop("rp").alias("sp"), F.stddev_pop("rg").alias("sg"), gain("place").alias("dcg"), gain("ideal").alias("best"))
    return t.select(by, F.when((F.col("n") < 2) | (F.col("sp") == 0) | (F.col("sg") == 0), 0.0).otherwise(F.col("c") / (F.col("sp") * F.col("sg"))).alias("spearman"), F.when(F.col("best") == 0, 0.0).otherwise(F.col("dcg") / F.col("best")).alias("ndcg"))


def stratified(rows: DataFrame, stratum: str, quotas: dict[str, int], key: str) -> DataFrame:
    """The first rows of each stratum by the hash of key, as many as its quota."""
    q = F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(stratum))
    w = Window.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.where(F.col(stratum).isin(list(quotas))).withColumn("place", F.row_number().over(w)).where(F.col("place") <= q)


def grade_evidence(evidence: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """by, n_sources, grade: multi from two sources, single, else weak; only confident evidence counts."""
    n = F.count_distinct(F.when(F.col("confidence") >= least, F.col("source_id")))
    return evidence.groupBy(*by).agg(n.alias("n_sources")).select(*by, "n_sources", F.when(F.col("n_sources") >= 2, "multi").when(F.col("n_sources") == 1, "single").otherwise("weak").alias("grade"))


def hierarchy_checks(parents: DataFrame, ids: DataFrame, aliases: DataFrame) -> DataFrame:
    """check, n: broken references, own parents, repeated ids and aliases (alias, id) that several ids claim; 0 is good."""
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    broken = parents.where("parent_id is not null").join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    return one("broken_parent", broken).union(one("own_parent", parents.where("parent_id = id"))).union(one("repeated_id", ids.groupBy("id").count().where("count > 1"))).union(one("alias_conflict", aliases.distinct().groupBy("alias").count().where("count > 1")))


def micro_macro(rows: DataFrame, key: str) -> DataFrame:
    """precision, recall, f1 of sums over keys, and macro_f1, the mean of each key's; rows is (key, gold, pred), one an item."""
    own = precision_recall(rows, [key])
    t = own.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("macro_f1"))
    div = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select(p.alias("precision"), r.alias("recall"), div(2 * p * r, p + r).alias("f1"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))


def tier_accuracy(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """n, accuracy: a missing prediction is wrong."""
    j = gold.select(*key, F.col("tier").alias("_gold")).join(pred.select(*key, F.col("tier").alias("_pred")), key, "left")
    return j.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("_gold").eqNullSafe(F.col("_pred")).cast("double")), F.lit(0.0)).alias("accuracy"))


def verdict_accuracy(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """n, accuracy over gold judgements (key, skill_id, verdict) of pairs that are predicted at all; a skill without a verdict is wrong."""
    there = pred.select(*key).distinct()
    j = gold.join(there, key, "left_semi").join(pred.select(*key, "skill_id", F.col("verdict").alias("_pred")), [*key, "skill_id"], "left")
    return j.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.coalesce((F.col("verdict") == F.col("_pred")).cast("double"), F.lit(0.0))), F.lit(0.0)).alias("accuracy"))


def verdict_accuracy_of_pairs(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """verdict_accuracy of tables with a row a pair: key and verdicts, an array of (skill_id, verdict), in which pred has a skill once.

    A pair is shuffled once, not each of its skills two or three times. Verdicts that are in one order in both tables aren't looked for.
    """
    j = gold.select(*key, "verdicts").join(pred.select(*key, F.col("verdicts").alias("_pred")), key)
    place = lambda v, i: F.when(F.get("_pred", i)["skill_id"] == v["skill_id"], i).otherwise(F.array_position(F.transform("_pred", lambda p: p["skill_id"]), v["skill_id"]).cast("int") - 1)
    right = F.size(F.filter("verdicts", lambda v, i: F.coalesce(v["verdict"] == F.get("_pred", place(v, i))["verdict"], F.lit(False))))
    n, ok = (F.coalesce(F.sum(x.cast("long")), F.lit(0)) for x in (F.size("verdicts"), right))
    return j.agg(n.alias("n"), ok.alias("_right")).select("n", F.when(F.col("n") == 0, 0.0).otherwise(F.col("_right") / F.col("n")).alias("accuracy"))


def filled_sample(rows: DataFrame, n: int, shares: dict[str, float], rest: str, key: str) -> DataFrame:
    """n rows, if there are: of each tier its share (what rounding leaves goes to rest), then leftovers in the order of shares.

    Within a tier rows are in the order of the hash of key. Tiers are few; places in a tier are a window over its rows.
    """
    quota = {t: int(n * s) for t, s in shares.items()}
    quota[rest] += n - sum(quota.values())
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.col("tier"))
    r = rows.where(F.col("tier").isin(list(shares))).withColumn("_place", F.row_number().over(Window.partitionBy("tier").orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)))
    over = F.col("_place") > lookup(quota)
    first = F.when(over, lookup({t: i + 1 for i, t in enumerate(shares)})).otherwise(0)
    return r.withColumn("_turn", first).orderBy("_turn", "_place", "tier").limit(n).drop("_turn", "_place")


def round_robin(rows: DataFrame, by: list[str], n: int, key: str) -> DataFrame:
    """n rows, one of each bucket in turn, in the order of the hash of key."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.withColumn("_turn", F.row_number().over(w)).orderBy("_turn", *by).limit(n).drop("_turn")


#: Degrees by what texts call them, years of experience, and marks of necessity and level.
DEGREES = [("博士", "博士"), ("硕士", "硕士"), ("研究生", "硕士"), ("本科", "本科"), ("大专", "大专"), ("专科", "大专"), ("学历不限", "不限"), ("不限学历", "不限")]
YEARS, YEARS_UP = r"([0-9]+)\s*[-~—–至到]\s*([0-9]+)\s*年", r"([0-9]+)\s*年以上"
PAY_K, PAY_W = r"([0-9]+(?:\.[0-9]+)?)\s*[-~—–]\s*([0-9]+(?:\.[0-9]+)?)\s*[Kk千]", r"([0-9]+(?:\.[0-9]+)?)\s*[-~—–]\s*([0-9]+(?:\.[0-9]+)?)\s*万"
BONUS_MARK = r"(?i)加分|优先|plus|了解即可|有则更好"
LEVEL_MARKS = [(3, r"精通|专家级|深入"), (2, r"掌握|熟悉|熟练|良好"), (1, r"了解|接触|听说")]
RANKS = [("expert", r"专家|总监|首席|研究员(?!实习)|Architect|Principal|资深专家"), ("senior", r"资深|高级|Senior|Lead|组长|负责人"), ("junior", r"初级|实习|校招|应届|Junior|助理")]


def education_of(stated: Column, text: Column) -> Column:
    """The degree that is stated, else the first of the list that the text names."""
    of = lambda c: F.coalesce(*[F.when(F.contains(c, F.lit(s)), v) for s, v in DEGREES])
    return F.coalesce(of(stated), of(text))


def experience_of(low: Column, high: Column, text: Column) -> Column:
    """Years as a range or from a number on: as stated, else as the text has them; 应届 for graduates."""
    got = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    stated = F.when(low.isNotNull() & (high > 0), F.concat(low.cast("string"), F.lit("-"), high.cast("string"), F.lit("年"))).when(low > 0, F.concat(low.cast("string"), F.lit("年以上")))
    return F.coalesce(stated, F.concat(got(YEARS, 1), F.lit("-"), got(YEARS, 2), F.lit("年")), F.concat(got(YEARS_UP, 1), F.lit("年以上")), F.when(F.contains(text, F.lit("应届")), "应届"))


def pay_of(low: Column, high: Column, text: Column) -> Column:
    """low and high a month: stated thousands, else a range in K or in 万 of the text."""
    got = lambda p, i, by: (F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("double") * by).cast("long")
    found = [F.coalesce(got(PAY_K, i, 1000), F.when(~text.rlike(PAY_K), got(PAY_W, i, 10000))) for i in (1, 2)]
    return F.struct(F.when(low.isNull(), found[0]).otherwise(low * 1000).cast("long").alias("low"), F.when(low.isNull(), found[1]).otherwise(high * 1000).cast("long").alias("high"))


def rank_of(title: Column, years: Column) -> Column:
    """expert, senior or junior, by marks in the title, else by years."""
    marked = F.coalesce(*[F.when(title.rlike(p), r) for r, p in RANKS])
    return F.coalesce(marked, F.when(years >= 8, "expert").when(years >= 3, "senior"), F.lit("junior"))


def family_of(title: Column, text: Column, patterns: dict[str, str], default: str) -> Column:
    """The family with the most points: one for a hit in title or text, two more in the title; the first of several, default without any."""
    score = lambda p: F.when(F.concat_ws("\n", title, text).rlike(p), 1).otherwise(0) + F.when(title.rlike(p), 2).otherwise(0)
    best = F.greatest(*[score(p) for p in patterns.values()], F.lit(0))
    return F.when(best == 0, default).otherwise(F.coalesce(*[F.when(score(p) == best, f) for f, p in patterns.items()]))


def lexicon_hits(text: str, forms: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """(name, start, end) of the skills of a lexicon's forms (form, name): longer forms first, one place of each name, none overlapping.

    ASCII forms are whole words in any case, others (and a plain C) stand as they are. C/C++ is both.
    """
    import re

    taken: list[tuple[int, int]] = []
    found: dict[str, tuple[int, int]] = {}
    free = lambda s, e: all(e <= a or s >= b for a, b in taken)
    for form, name in sorted(forms, key=lambda f: (-len(f[0]), f)):
        if not form or name in found:
            continue
        word = form.isascii() and form.lower() != "c"
        pattern = rf"(?i)(?<![A-Za-z0-9_+]){re.escape(form)}(?![A-Za-z0-9_+])" if word else f"(?={re.escape(form)})"
        places = ((m.start(), m.start() + len(form)) for m in re.finditer(pattern, text))
        place = next((p for p in places if free(*p)), None)
        if place is None:
            continue
        taken.append(place)
        if form.replace(" ", "").lower() == "c/c++":
            found["C 语言"], found["C++"] = (place[0], place[0] + 1), (place[1] - 3, place[1])
        else:
            found[name] = place
    return sorted(((n, s, e) for n, (s, e) in found.items()), key=lambda x: x[1])


def lexicon_skills(docs: DataFrame, forms: list[tuple[str, str]]) -> DataFrame:
    """doc_id, name, start, end, surface, necessity (of the 80 characters before), level_hint (of 12 before and 8 after the start)."""
    import pandas as pd

    shared = docs.sparkSession.sparkContext.broadcast(forms)  # a lexicon

    def run(frames):
        for f in frames:
            rows = [(i, n, s, e, t[s:e]) for i, t in zip(f["doc_id"], f["text"]) if t for n, s, e in lexicon_hits(t, shared.value)]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "start", "end", "surface"])

    hits = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, name string, start int, end int, surface string").join(docs.select("doc_id", "text"), "doc_id")
    part = lambda back, on: F.substr("text", F.greatest(F.col("start") - back, F.lit(0)) + 1, F.least(F.col("start"), F.lit(back)) + on)
    need = F.when(part(80, 0).rlike(BONUS_MARK), "bonus").otherwise("required")
    level = F.coalesce(*[F.when(part(12, 8).rlike(p), n) for n, p in LEVEL_MARKS])
    return hits.select("doc_id", "name", "start", "end", "surface", need.alias("necessity"), level.alias("level_hint"))


#: Surfaces that mean something else more often than a skill, folded.
BLOCKED = ["go", "r", "c", "agent", "ch", "java岛", "sd", "tf"]


def claimed_aliases(claims: DataFrame) -> DataFrame:
    """surface, surface_folded, skill_id, source: of claims (surface, skill_id, source, place) on a folded surface the first; blocked and
    one-character surfaces have none."""
    surface = F.btrim(F.regexp_replace("surface", r"\s+", " "))
    c = claims.withColumn("surface", surface).withColumn("surface_folded", F.lower("surface"))
    c = c.where((F.length("surface_folded") >= 2) & ~F.col("surface_folded").isin(BLOCKED))
    first = c.groupBy("surface_folded").agg(F.min_by(F.struct("surface", "skill_id", "source"), "place").alias("f"))
    return first.select("f.surface", "surface_folded", "f.skill_id", "f.source")


def ontology_errors(skills: DataFrame, aliases: DataFrame, clusters: DataFrame, least: int = 600) -> DataFrame:
    """check, n of a vocabulary: too few skills or aliases, repeated or malformed ids, no aliases, unknown clusters, parents and alias
    targets, aliases of several skills, and parents in a cycle. 0 is good."""
    from . import match

    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    ids = skills.select("id").where("id is not null")
    few = skills.agg(F.count("*").alias("s")).crossJoin(aliases.agg(F.count("*").alias("a")))  # one row each
    parents = skills.where("parent_id is not null")
    known = parents.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    loops = match.closure(known.select(F.col("parent_id").alias("src"), F.col("id").alias("dst")))
    # A skill is in or behind a cycle if two of its ancestors need each other.
    cyclic = loops.alias("x").join(loops.alias("y"), (F.col("x.skill_id") == F.col("y.needs")) & (F.col("x.needs") == F.col("y.skill_id"))).select("x.skill_id").distinct()
    parts = [
        ("few_skills", few.where(F.col("s") < least)), ("few_aliases", few.where("a < 2 * s")), ("repeated_id", ids.groupBy("id").count().where("count > 1")), ("malformed_id", ids.where("id not like 'skill.%'")),
        ("no_alias", skills.where("aliases is null or size(aliases) = 0")), ("unknown_cluster", skills.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_anti")),
        ("unknown_parent", parents.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")), ("own_parent", skills.where("parent_id = id")),
        ("unknown_target", aliases.join(ids.select(F.col("id").alias("skill_id")), "skill_id", "left_anti")), ("alias_conflict", aliases.groupBy(F.lower("surface")).agg(F.count_distinct("skill_id").alias("k")).where("k > 1")), ("parent_cycle", cyclic),
    ]
    out = None
    for name, df in parts:
        out = one(name, df) if out is None else out.unionByName(one(name, df))
    return out


def attach_resources(skills: DataFrame, candidates: DataFrame, cached: DataFrame | None = None, picked: DataFrame | None = None, reachable: DataFrame | None = None, most: int = 3) -> DataFrame:
    """skill_id, place, url, title, kind: the cached resources of a skill, else up to three candidates (skill_id, place, url, title, kind).

    picked (skill_id, place, url) chooses among candidates, in its order; urls that are no candidates don't count, and a skill without
    picks keeps its first candidates. Of reachable (url), if given, others are left out.
    """
    shape = ["skill_id", "place", "url", "title", "kind"]
    known = cached.select(shape) if cached is not None else None
    todo = skills.select("skill_id").distinct()
    new = candidates.join(todo.join(known.select("skill_id").distinct(), "skill_id", "left_anti") if known is not None else todo, "skill_id", "left_semi")
    if picked is not None:
        p = picked.groupBy("skill_id", "url").agg(F.min("place").alias("pick"))
        asked = picked.select("skill_id").distinct().withColumn("asked", F.lit(True))
        new = new.join(p, ["skill_id", "url"], "left").join(asked, "skill_id", "left").where("asked is null or pick is not null").withColumn("place", F.coalesce("pick", "place"))
    w = Window.partitionBy("skill_id").orderBy("place", "url")
    new = new.dropDuplicates(["skill_id", "url"]).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(shape)
    out = new.unionByName(known.join(todo, "skill_id", "left_semi")) if known is not None else new
    return out.join(reachable.select("url").distinct(), "url", "left_semi").select(shape) if reachable is not None else out
