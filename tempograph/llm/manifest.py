"""A Merkle manifest of a dataset: a tree of each group's leaves, a tree of the groups' roots, and proofs from parents' preimages.

A leaf is the hash of a row's fields. Leaves stand in order in their group; every WIDTH consecutive nodes, the last ones of a level
may be fewer, become the hash of their concatenated hashes until one is left, the group's subroot. Subroots become a root likewise.

Each level is one aggregation by (group, place / WIDTH), an eighth of the one below; places come from ranges of the order, so no
group, however large, lies in one task. A parent is stored as its preimage, the concatenated hashes of its children. From the
top down each parent is given its own ancestors' preimages, and leaves are joined with their parent's. A leaf's siblings are
what is left of a preimage when the leaf's own slot of 64 characters is cut out; for folding another hash is put in that slot.

Any field may be null ('-'). Rows without doc_id stand first in their group; rows of one doc_id stand by their leaves' hashes, and
equal rows are leaves of their own with the same hash. The group of null lang is apart from that of an empty one, before it.
A null doc_id is never tampered with. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ordinals, read_table

WIDTH, SLOT = 8, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of the fields, each as '-' if null, else its bytes in UTF-8, ':' and the value."""
    parts = [F.when(f.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f)) for f in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*parts), 256)


def levels(nodes: DataFrame, width: int = WIDTH) -> list[DataFrame]:
    """Parents (group, place, preimage, hash, size) of nodes (group, place, hash, size), level by level, each written.

    size is how many nodes the group has on the level; groups that are down to one node have no parents.
    """
    found = []
    while nodes.agg(F.max("size")).first()[0] not in (None, 1):
        child = F.struct((F.col("place") % width).alias("slot"), "hash")
        above = F.floor(F.col("place") / width).cast("long").alias("place")
        runs = nodes.where("size > 1").groupBy("group", above).agg(F.array_sort(F.collect_list(child)).alias("run"), F.first("size").alias("below"))
        preimage = F.array_join(F.transform("run", lambda c: c["hash"]), "").alias("preimage")
        parents = runs.select("group", "place", preimage, F.ceil(F.col("below") / width).cast("long").alias("size"))
        nodes = cut(parents.withColumn("hash", F.sha2("preimage", 256)))
        found.append(nodes)
    return found


def climb(nodes: DataFrame, parents: DataFrame, width: int) -> DataFrame:
    """nodes with path, their parents' preimage and path put together, and what else parents (group, place, preimage, path, ...) have."""
    of = parents.withColumnsRenamed({"place": "_place", "preimage": "_preimage", "path": "_path"})
    joined = nodes.withColumn("_place", F.floor(F.col("place") / width).cast("long")).join(of, ["group", "_place"])
    own = F.struct(F.col("_preimage").alias("preimage"), (F.col("place") % width * SLOT).cast("int").alias("at"))
    return joined.withColumn("path", F.concat(F.array(own), "_path")).drop("_place", "_preimage", "_path")


def parents_with_paths(tree: list[DataFrame], above: DataFrame, width: int) -> DataFrame:
    """group, place, preimage, path, subroot of the lowest parents: a path has the preimages of ancestors, bottom up, and the own place in each.

    above: group, subroot and path from there to the root.
    """
    found = None
    for level in reversed(tree):
        level = level.select("group", "place", "preimage", "size")
        tops = level.where("size = 1").join(above, "group")
        found = tops if found is None else tops.unionByName(climb(level.where("size > 1"), found.drop("size"), width))
    return found.drop("size")


def siblings(path: Column) -> Column:
    """What a proof has: each preimage without the own slot, from the leaf to the root."""
    rest = lambda s: F.concat(F.substring(s["preimage"], F.lit(1), s["at"]), F.substring(s["preimage"], s["at"] + SLOT + 1, F.length(s["preimage"])))
    return F.array_join(F.transform(path, rest), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.overlay(s["preimage"], h, s["at"] + 1, F.lit(SLOT)), 256))


def proofs(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple = FIELDS, changed: dict[str, Column] | None = None, width: int = WIDTH) -> DataFrame:
    """id, leaf, now, subroot, root, path of each row; now is the leaf of the row with the changed fields."""
    name = F.concat(F.col(group).isNotNull().cast("int").cast("string"), F.coalesce(F.col(group).cast("string"), F.lit("")))
    held = [F.col(f"`{c}`") for c in fields]
    now = leaf_hash([(changed or {}).get(c, x) for c, x in zip(fields, held)])
    by = [F.col(order).isNotNull().cast("int").alias("_has"), F.coalesce(F.col(order), F.lit(0)).alias("_by")]
    leaves = docs.select(name.alias("group"), F.col(order).alias("id"), *by, leaf_hash(held).alias("hash"), now.alias("now"))
    leaves = cut(ordinals(cut(leaves), "group", ["_has", "_by", "hash"]).drop("_has", "_by"))
    tree = levels(leaves.select("group", "place", "hash", "size"), width)
    tops = leaves.where("size = 1").select("group", "hash")
    for level in tree:
        tops = tops.unionByName(level.where("size = 1").select("group", "hash"))
    # The subroots' tree: all in one group, in the order of the groups' names.
    tops = cut(ordinals(tops.select(F.lit("").alias("all"), F.col("group").alias("name"), "hash"), "all", ["name"]))
    tops = tops.withColumnRenamed("all", "group")
    upper = levels(tops.select("group", "place", "hash", "size"), width)
    path = F.array().cast("array<struct<preimage:string,at:int>>").alias("path")
    if upper:
        root = upper[-1].select("group", F.col("hash").alias("root"), path)
        above = climb(tops, parents_with_paths(upper, root, width), width)
    else:
        above = tops.select("*", F.col("hash").alias("root"), path)
    above = cut(above.select(F.col("name").alias("group"), F.col("hash").alias("subroot"), "root", "path"))
    lone = leaves.where("size = 1").join(above, "group")
    found = lone.unionByName(climb(leaves.where("size > 1"), parents_with_paths(tree, above, width), width)) if tree else lone
    return found.select("id", F.col("hash").alias("leaf"), "now", "subroot", "root", "path")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    found = proofs(docs, changed={"text": text}).withColumn("folded_root", fold(F.col("now"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")), 256)
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)), 4294967295)"
_LEAF = "sha256({})".format(" || ".join(f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars")) + " || coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')")


def _sql_tree(rows: str, name: str, most: int) -> str:
    """Common table expressions {name}0.. with g, pos, h and n of each level, from level 1 on with the preimage, too."""
    levels = [f"{name}0 AS (SELECT g, pos, h, n FROM {rows})"]
    for k in range(1, most + 1):
        levels.append(f"{name}{k} AS (SELECT g, pos // {WIDTH} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, string_agg(h, '' ORDER BY pos) AS pre, (any_value(n) + {WIDTH - 1}) // {WIDTH} AS n FROM {name}{k - 1} WHERE n > 1 GROUP BY g, pos // {WIDTH})")
    return ", ".join(levels)


def _sql_climb(rows: str, name: str, most: int, key: str) -> str:
    """Common table expressions that carry rows (g, pos, sib, now) up the levels of a tree."""
    out, last = [], rows
    for k in range(1, most + 1):
        place = f"r.{key} // {WIDTH ** (k - 1)}"
        slot = f"CAST(({place}) % {WIDTH} * {SLOT} AS INT)"
        out.append(f"{name}{k} AS (SELECT r.* EXCLUDE (sib, now), r.sib || coalesce(substr(p.pre, 1, {slot}) || substr(p.pre, {slot} + {SLOT + 1}), '') AS sib, CASE WHEN p.pre IS NULL THEN r.now ELSE sha256(substr(p.pre, 1, {slot}) || r.now || substr(p.pre, {slot} + {SLOT + 1})) END AS now FROM {last} r LEFT JOIN {name[0]}{k} p ON r.g = p.g AND ({place}) // {WIDTH} = p.pos)")
        last = f"{name}{k}"
    return ", ".join(out)


#: Levels that the SQL goes up: 8^7 leaves of one lang, 8^3 langs.
DEEP, WIDE = 7, 3
OP11_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, {_LEAF.format("text")} AS leaf,
  CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_LEAF.format("text")} END AS now FROM documents),
l AS (SELECT *, leaf AS h, '' AS sib, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_sql_tree("l", "t", DEEP)},
s AS (SELECT g AS name, h AS subroot FROM ({" UNION ALL ".join(f"SELECT g, h FROM t{k} WHERE n = 1" for k in range(DEEP + 1))})),
u AS (SELECT 0 AS g, name, subroot, subroot AS h, row_number() OVER (ORDER BY name) - 1 AS pos, count(*) OVER () AS n FROM s),
{_sql_tree("u", "o", WIDE)},
z AS (SELECT h AS root FROM ({" UNION ALL ".join(f"SELECT h FROM o{k} WHERE n = 1" for k in range(WIDE + 1))})),
{_sql_climb("l", "tt", DEEP, "pos")},
m AS (SELECT tt{DEEP}.* EXCLUDE (g, pos), 0 AS g, u.pos AS pos, u.subroot FROM tt{DEEP} JOIN u ON tt{DEEP}.g = u.name),
{_sql_climb("m", "oo", WIDE, "pos")}
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, now AS folded_root, now = root AS verified FROM oo{WIDE}, z
"""
