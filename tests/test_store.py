"""Stores: partitions that a write leaves alone, joins without a shuffle, schema versions; and functions in SQL."""

import pytest
from pyspark.sql import functions as F

from tempograph.functions import sql, text
from tempograph.operators import store
from tempograph.sources.files import first_existing
from tempograph.sources.shared import forget, kept, shared_folder

SCHEMA = "role_id string, skill_id string, period string, weight double, posting_count long, total_postings long, ontology_version string"


@pytest.fixture
def db(spark):
    root = shared_folder(spark)
    name = "t_" + root.rsplit("-", 1)[-1]
    assert store.migrate(spark, root, name) == sorted(store.MIGRATIONS)
    spark.root = root
    return name


def edges(spark, *rows):
    return spark.createDataFrame([(r, s, p, w, n, 10, v) for r, s, p, w, n, v in rows], SCHEMA)


def files(spark, name):
    return {r.f: r.p for r in spark.table(name).select(F.input_file_name().alias("f"), F.concat_ws("/", *store.PARTS).alias("p")).distinct().collect()}


@pytest.mark.parametrize("table,put", [("observation", store.put_observations), ("requires", store.put_graph)])
def test_a_write_touches_its_partitions_only(spark, db, table, put):
    rows = [(f"r{i}", f"s{k}", p, 0.5, i, "1") for i in range(20) for k in range(3) for p in ("2024Q1", "2024Q2")]
    put(spark, db, edges(spark, *rows, ("r1", "s1", "2024Q1", 0.5, 1, "2")))
    before = files(spark, f"{db}.{table}")
    assert put(spark, db, edges(spark, ("r1", "s1", "2024Q1", 0.9, 2, "1"), ("r1", "s1", "2024Q1", 0.8, 1, "1"), ("new", "s9", "2024Q1", 0.1, 1, "1"))) == [("1", "2024Q1")]
    after = files(spark, f"{db}.{table}")
    left = lambda f: {x for x, p in f.items() if p != "1/2024Q1"}
    assert left(before) == left(after) and not ({x for x, p in before.items() if p == "1/2024Q1"} & set(after))
    t = spark.table(f"{db}.{table}")
    assert t.count() == len(rows) + 2 and t.where("role_id = 'r1' and skill_id = 's1' and period = '2024Q1' and ontology_version = '1'").select("weight", "posting_count").collect() == [(0.9, 2)]
    assert t.where("period = '2024Q1' and ontology_version = '2'").count() == 1
    assert put(spark, db, edges(spark)) == [] and spark.table(f"{db}.{table}").count() == len(rows) + 2


def test_slices_join_without_a_shuffle(spark, db):
    store.put_graph(spark, db, edges(spark, *[(f"r{i}", f"s{k}", p, 0.5, 1, "1") for i in range(30) for k in range(4) for p in ("2024Q1", "2024Q2")]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        a, b = (store.slice_edges(spark, db, "1", p) for p in ("2024Q1", "2024Q2"))
        joined = a.join(b, ["role_id", "skill_id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("PartitionFilters") == 2 and joined.count() == 120
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_nodes_are_made_and_kept(spark, db):
    roles = spark.createDataFrame([("a", "A", "draft"), ("z", "Z", "draft")], "role_id string, name string, state string")
    store.put_graph(spark, db, edges(spark, ("a", "s", "2024Q1", 0.5, 1, "1"), ("b", "s", "2024Q1", 0.5, 1, "1")), roles)
    store.put_graph(spark, db, edges(spark, ("a", "s", "2024Q2", 0.5, 1, "2"), ("c", "t", "2024Q2", 0.5, 1, "2")), roles.where("role_id = 'a'").withColumn("state", F.lit("published")))
    assert sorted(map(tuple, spark.table(f"{db}.role").collect())) == [("a", "A", "published"), ("b", "b", "published"), ("c", "c", "published"), ("z", "Z", "draft")]
    assert sorted(map(tuple, spark.table(f"{db}.skill").collect())) == [("s", "s", "1"), ("t", "t", "2")]


@pytest.mark.parametrize("row", [("a", "s", "2024-Q1", 0.5, 1, "1"), ("a", "s", None, 0.5, 1, "1"), (None, "s", "2024Q1", 0.5, 1, "1"), ("", "s", "2024Q1", 0.5, 1, "1")])
def test_bad_rows_are_refused(spark, db, row):
    with pytest.raises(ValueError, match="2024Q1"):
        store.put_graph(spark, db, edges(spark, row))
    assert spark.table(f"{db}.requires").count() == 0


def test_a_new_session_finds_what_is_stored(spark, db):
    store.put_observations(spark, db, edges(spark, (None, "s", "2024Q1", 0.5, 1, "1"), ("r", "s", "2024Q1", 0.5, 1, "1")))
    other = f"{db}_again"
    assert store.migrate(spark, spark.root, other) == [] and spark.table(f"{other}.observation").count() == 2
    assert spark.table(f"{other}.{store.LEDGER}").count() == len(store.MIGRATIONS)


def test_functions_in_sql(spark):
    assert sql.register(spark) == list(sql.FUNCTIONS)
    sql.register(spark, {"Java": "s.java", "C++": "s.cpp", "Java 17": "s.java"}, "scan_test")
    spark.createDataFrame([(1, "Java 17 and C++, JavaScript"), (2, None), (3, "")], "id int, text string").createOrReplaceTempView("scan_texts")
    got = spark.sql("SELECT id, s.* FROM scan_texts, LATERAL scan_test(text) s ORDER BY start_at").collect()
    assert [tuple(r) for r in got] == [(1, 0, 7, "s.java", "Java 17"), (1, 12, 15, "s.cpp", "C++")]
    assert spark.sql("SELECT normalize_title('Java 研发工程师') t, html_text('<p>a</p><script>b</script>') h, indel_ratio('ab', 'ac') i, gram_jaccard('abcd', 'abcd') g").first() == ("java开发", "a", 50.0, 1.0)


def test_dictionaries_are_bounded(monkeypatch):
    monkeypatch.setattr(text, "MAX_SURFACES", 2)
    with pytest.raises(ValueError, match="surfaces"):
        sql.scanner({"a": "1", "b": "1", "c": "1"})


def test_kept_tables_can_be_forgotten(spark):
    forget(spark)
    df = kept(spark.range(3))
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert df.count() == 3 and first_existing(spark, [path]) == path
    assert forget(spark) == 1 and first_existing(spark, [path]) is None and forget(spark) == 0
