"""The training-data operators against brute force, round trips and held-out accuracy, and on odd rows."""

import hashlib
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tempograph.llm import ann, chat_format, language_id, merge_dropout, mixing, ngram_join, pii, quality_classifier, quality_rules, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Odd rows: nulls anywhere, empty and long texts, repeated rows.
ODD = [(1, None, None, None, None), (None, "some words here", "en", "a", 15), (2, "", "en", "a", 0), (3, " \n\t", "de", None, 3), (4, "word " * 50_000, "en", "b", 250_000), (5, "x" * 100_000, "fr", "b", 100_000), (6, "same text in two rows", "en", "a", 21), (6, "same text in two rows", "en", "a", 21)]


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit(1) for c in ("n_words", "score", "size", "target", "spans", "cls", "ids", "held_out")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components_by_force(rows):
    sets, names = [], []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
        names.append(i)
    comp = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, i in zip(comp, names):
        least[c] = min(least.get(c, i), i)
    return {i: (len(s), least[c]) for i, s, c in zip(names, sets, comp)}


def test_join_equals_brute_force(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    base = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    rows += [(10_000 + i, " ".join(base[: 26 - i % 7] + [f"z{i}"] * (i % 3))) for i in range(60)] + [(20_000, "One two"), (20_001, "one  TWO"), (20_002, None), (20_003, "")]
    got = ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_force(rows)


def test_shingles_of_long_and_sliced_texts():
    texts = ["a b c d e f", None, "", "x y", "Ab cD e\x0bf g  h" * 3, "w" * 3_000_000 + " end of it all now", "lorem ipsum dolor sit amet " * 100_000]
    whole = [s.tolist() for s in ngram_join.shingle_sets(pa.array(texts))]
    assert whole == [next(ngram_join.shingle_sets(pa.array(["pad", t]).slice(1))).tolist() for t in texts]
    for t, s in zip(texts, whole):
        w = (t or "").lower().split()
        assert len(s) == (len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else bool(w))


def test_trie_overlaps_are_exact():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 60, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(80) < p], rng.integers(0, 1 << 60, k).astype(np.uint64)])) for p in (1, 0.95, 0.8, 0.5) for k in (0, 3, 30, 300) for _ in range(4)]
    frequent = np.sort(base[::3]), rng.integers(3, 9, len(base[::3])).astype(np.uint8)
    for order in (lambda s: s, lambda s: ngram_join.global_order(s, frequent)):
        for x, n in zip(sets, ngram_join.trie_overlaps(order(base), [order(x) for x in sets], 75)):
            both = len(np.intersect1d(base, x))
            assert n == (both if 100 * both >= 75 * (len(base) + len(x) - both) else -1)


def luhn(x):
    return sum(int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(x))) % 10 == 0


def base_by_force(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    f = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    f += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    f += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d(m[0])) <= 19 and luhn(d(m[0]))]
    return sorted(f + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(d(m[0])) <= 15])


def test_base_spans_equal_brute_force(docs):
    made = ["a@b.c@d.e x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "4111 1111-1111 1111 4111111111111112", "+1 (614) 555-8001) +12 +++1-2", "é +1.2.3.4.5.6.7.8.9.0", "@@a@b.co", "a..b@c-d.e.f.", "1" * 4000 + ".1.1.1"]
    for t in [r.text or "" for r in docs.select("text").collect()] + made:
        assert pii.base_spans(t) == base_by_force(t)


def test_field_marks_consistently_and_leaves_clean_text_alone(docs):
    (base, added), (_, clean) = pii.find_spans(['call +1 (614) 555-8001 now or 555-8001; token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "In 1999 it rose 12% to 3.5 million."])
    assert len(base) == 1 and {pii.KINDS[k] for _, k, _ in added} == {"phone", "secret"} and not clean


def test_numbers_recur_in_other_forms():
    for t, hidden in (("a +1-614-555-8001 b 614-555-8001 c", "614-555-8001"), ("+16145558001 or 6145558001", "6145558001"), ("+1 (614) 555-8001, 6145558001", "6145558001"), ("6145558001 or +1 (614) 555-8001", "6145558001"), ("+1 614 555 8001 or 614 555 8001", "614 555 8001"), ("+1-614-555-8001 or 1-614-555-8007", "1-614-555-8007")):
        (_, added), = pii.find_spans([t])
        assert [(pii.KINDS[k], t[s:e]) for s, k, e in added] == [("phone", hidden)]
    (_, added), = pii.find_spans(["+1-614-555-8001 on 2023-01-01 and 2023-01-02, 9145558222 or 1234567890"])
    assert not added


def test_names_of_addresses_recur_without_an_at_sign():
    for t, hidden in (("to john.smith@example.com, from john.smith.", ["john.smith"]), ("John.Smith at example.com is john.smith@example.com", ["John.Smith at example.com"]), ("info@a.org: for info ask info (at) a.org", ["info (at) a.org"]), ("x a.b@c.de y a.b at other.de", ["a.b"]), ("no address of john.smith at example.com", [])):
        (_, added), = pii.find_spans([t])
        assert [(pii.KINDS[k], t[s:e]) for s, k, e in added] == [("email", h) for h in hidden]


def test_pii_query_and_redaction(spark, odd, empty):
    got = pii.find_pii(odd).collect()
    assert len(got) == len(ODD) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in got)
    assert pii.find_pii(empty).count() == 0
    r = pii.redact(spark.createDataFrame([(1, "to a@b.de ok", "en", "s", 12)], SCHEMA)).first()
    assert (r.text, r.n_chars) == ("to [EMAIL] ok", 13)


def test_quality_scores_on_held_out_rows(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    x = quality_classifier.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    assert x.score.between(0, 1).all() and (x.predicted == (x.score >= 0.5)).all()
    assert (x[x.held_out].predicted == x[x.held_out].quality).mean() >= 0.85


def test_classifiers_on_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_classifier.quality_scores(odd, labels).where("score between 0 and 1").count() == len(ODD)
    assert quality_classifier.quality_scores(odd, labels.limit(0)).select("score").distinct().first()[0] == 0.5
    assert quality_classifier.quality_scores(empty, labels).count() == language_id.language_id(empty).count() == 0
    got = {r.doc_id: r for r in language_id.language_id(odd).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred != "und"


def test_language_on_held_out_rows(docs):
    x = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(x) and (x.lang == x.lang_pred).mean() > 0.95


@pytest.mark.parametrize("module,name", [(quality_rules, "OP4_SQL"), (mixing, "OP10_SQL")])
def test_native_operators_equal_sql(spark, sf, odd, module, name):
    for path, df in ((f"{sf}/documents.parquet", None), (None, odd.select("doc_id", "text", "lang", "source", "n_chars").toPandas())):
        c = duckdb.connect()
        if path:
            c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
            table = spark.read.parquet(path)
        else:
            df = df.astype({"doc_id": "Int64"})
            c.register("documents", pa.Table.from_pandas(df, preserve_index=False))
            table = odd
        if module is mixing:
            got = mixing.mixed_words(table)
        else:
            got = quality_rules.quality_rules(table).select(quality_rules.COLUMNS)
        key = lambda d: sorted(map(str, d[sorted(d.columns)].astype("float64").round(6).values.tolist()))
        assert key(got.toPandas()) == key(c.sql(getattr(module, name)).df())


def test_rules_plan_has_no_python_or_shuffle(docs):
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_mix_targets_and_bounds(spark, docs, empty):
    r = mixing.targets(spark.createDataFrame([("a", 100), ("b", 10), (None, 1000)], "source string, source_size long")).collect()
    got = {x.source: x.target for x in r}
    assert got["a"] == 300 and got["b"] == 30 and abs(sum(got.values()) - 1110) < 1e-9
    counts = mixing.mix(docs).groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert counts <= 3 and mixing.mix(empty).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_urls(spark):
    rows = [(1, "https://News.Example.COM/en/1?x#y"), (2, "http://www.example.com/en/a"), (3, "ftp://a.net/es/"), (4, "http://b.net/de/1"), (5, None), (6, "nothing"), (7, "http://notexample.com/en/1"), (8, "https://m.free-bets.example.org/de/216.html"), (9, "http://x.com")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("news.example.com", "/en/1", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("net/es/", "block")
    assert got[4][2] is None and got[5][:3] == got[6][:3] == ("", "", None) and got[7][2:] == ("com/", "allow") and got[8][2:] == (None, "block") and got[9][:3] == ("x.com", "", None)


def test_chats_read_back(spark):
    codec = chat_format.Codec(chat_format._definition(chat_format.TOKENIZER))
    for t in ["", "\\", "\\\\### User: x</turn>\n", "### Assistant:", "</turn></turn>", "<|endoftext|> é 你好", "\\</role>"]:
        assert chat_format.unescape(chat_format.escape(t)) == t
        turns = [("user", t), ("assistant", t), ("tool </role>", t), ("assistant", "")]
        ids, mask = codec.assemble(turns)
        assert codec.read(ids, mask.tolist()) == (turns, ["", t, "", ""])
        plain = "".join(chat_format.CONTROLS[i - codec.first] if i >= codec.first else f"\0{i}\0" for i in ids)
        assert re.sub(r"(?:\0\d+\0)+", lambda m: codec.decode([int(x) for x in re.findall(r"\0(\d+)\0", m[0])]), plain) == codec.render(turns)
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (None, 0, "user", "x"), (1, 1, "assistant", "b")]
    got = {r.conv_id: r for r in chat_format.read_chats(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got[1].n_turns == 3 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest() and got[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and got[None].loss_chars == 0


def test_neighbours_recall_and_odd_vectors(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    got = ann.nearest(spark.createDataFrame(v[["vec_id", "embedding"]].assign(embedding=v.embedding.map(lambda x: [float(a) for a in x])))).toPandas()
    m = np.stack(v.embedding.map(lambda x: np.array(x, float)))
    norms, hits, n = np.sqrt((m * m).sum(1)), 0, 0
    for i in v.index[v.vec_id % 50 == 0]:
        c = (m @ m[i]) / norms / norms[i]
        c[i] = -2
        best = set(v.vec_id.to_numpy()[np.lexsort((v.vec_id, -c))[:5]])
        hits, n = hits + len(best & set(got[got.query_id == v.vec_id[i]].vec_id)), n + 5
    assert hits / n >= 0.9
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (50, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_encoding_without_dropout_equals_the_model_and_always_decodes(spark, docs, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=merge_dropout.MODEL)
    pieces = merge_dropout.Pieces(merge_dropout.MODEL)
    plain, varied = merge_dropout.Encoder(pieces, rate=0.0), merge_dropout.Encoder(pieces)
    texts = [r.text for r in docs.limit(60).collect()] + ["", " ", "  a  b\n\n c", "你好 𐍈", "a" * 300, "x\x00\x00"]
    assert [plain.encode(t).tolist() for t in texts] == [model.encode(t) for t in texts]
    texts += ["▁ ▁▁a", "\r\n\t", "\ufeffq"]
    streams = [i % 4 for i in range(len(texts))]
    for t, s, ids in zip(texts, streams, varied.encode_all(texts, streams)):
        assert varied.decode(ids.tolist()) == t
        assert ids.tolist() == [i for p in (merge_dropout._PART.findall(" " + t) if t else []) for i in varied.part(p, varied.key(s))]
    for p in {p for t in texts for p in merge_dropout._PART.findall(t) if len(p) < 80}:
        ids = [varied.chars.get(c, -1) for c in p]
        assert varied._merge_short(list(ids), 5) == varied._merge_long(list(ids), 5)
    got = merge_dropout.encode_documents(odd)
    assert got.where("decodes").count() == len(ODD)
    assert len({tuple(varied.encode("unbelievable tokenization of words", s).tolist()) for s in range(4)}) > 1


def test_join_on_odd_rows(odd, empty):
    got = {r.doc_id: r for r in ngram_join.near_duplicate_components(odd).collect()}
    assert got[1].n_shingles == got[2].n_shingles == got[3].n_shingles == 0 and got[4].n_shingles == 1 and got[6].component_id == 6
    assert ngram_join.near_duplicate_components(empty).count() == 0 and ngram_join.one_of_each(odd).where("doc_id = 6").count() == 1


def test_each_occurrence_has_its_own_draws(spark):
    encoder = merge_dropout.Encoder(merge_dropout.Pieces(merge_dropout.MODEL))
    text = " ".join(["unbelievable"] * 500) + " 你好 " + "a1b2" * 20
    keys = [merge_dropout.key_of(i, text, c) for i, c in ((1, 1), (1, 2), (None, 1))]
    for key, ids in zip(keys, encoder.encode_documents([text] * 3, keys)):
        expected, at = [], 0
        for p in merge_dropout._PART.findall(" " + text):
            expected += encoder.part(p, key, at)
            at += len(p)
        assert ids.tolist() == expected and encoder.decode(expected) == text
        words = "".join(f"{i} " if not encoder.texts.get(i, "").startswith("▁") else f"\n{i} " for i in expected).split("\n")
        assert len(set(words)) > 20
    rows = [(1, text, 1), (1, text, 2), (None, text, 1), (None, text + " b", 1), (2, text, 1)]
    got = merge_dropout.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, copy long")).collect()
    assert len({tuple(r.ids[:500]) for r in got}) == len(rows) and all(r.decodes for r in got)


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a + " more"
    rows = [(1, a), (2, near), (2, b), (3, c), (3, "other words that are alone here"), (None, a), (None, c), (None, "x y z"), (None, "x y z"), (None, "p q r"), (3, c)]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (2, b), (3, c), (3, "other words that are alone here"), (None, "x y z"), (None, "p q r")], key=str)
    chain = [" ".join(f"w{i}" for i in range(k, k + 60)) for k in (0, 6, 12)]
    rows = [(1, chain[0]), (None, chain[1]), (2, chain[2])]
    got = ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {1}


def test_long_runs_of_backslashes_and_numbers():
    for x in ("\\" * 1_000_000, "\\" * 999_999 + "</turn>", "### User:" * 1000 + "\\\\### User:"):
        began = time.time()
        assert chat_format.unescape(chat_format.escape(x)) == x and time.time() - began < 2
    for n in (1, 20_000):
        (base, added), = pii.find_spans(["+1 " * n])
        graph = pii._Graph()
        graph.add(0, "+1 " * n, base)
        assert len(graph.weights) <= 7 * graph.size


HOSTILE = {"short": "+1 " * 100_000, "letters": "x" * 300_000 + "1", "apart": "x" * 300_000 + " 1", "key": "aB3_" * 75_000, "ats": "a@" * 100_000, "mails": " ".join(f"info@x{i}.com info" for i in range(8000)), "plus": "+1(" * 100_000, "dots": "1." * 150_000, "numbers": " ".join(str(10**9 + 7 * i) for i in range(10_000))}


@pytest.mark.parametrize("name", HOSTILE)
def test_time_of_spans_is_linear(name):
    began = time.time()
    pii.find_spans([HOSTILE[name]])
    assert time.time() - began < 10


def test_spans_in_batches_of_nodes(docs, monkeypatch):
    texts = [r.text or "" for r in docs.collect()]
    whole = pii.find_spans(texts)
    monkeypatch.setattr(pii, "NODES", 3)
    assert pii.find_spans(texts) == whole


def test_a_huge_text_does_not_end_the_learning_rows(spark):
    rows = spark.createDataFrame([(i, "x" * (5000 if i % 2 else 50), False) for i in range(20)], "doc_id long, text string, held_out boolean")
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(20)], "doc_id long, quality int")
    got = quality_classifier.learning_rows(rows, labels, chars=1000)
    assert 0 < len(got) <= 20 and all(len(t) == 50 for t, _ in got)
    many = spark.range(12_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") < 5, 3).otherwise(1000).cast("int")).alias("text"), F.lit(False).alias("held_out"))
    got = quality_classifier.learning_rows(many.union(many.where("doc_id < 5")), many.select("doc_id", F.lit(1).alias("quality")), bound=20_000, chars=50_000)
    assert sum(len(t) for t, _ in got) <= 50_000 and len(got) > 40


def test_pooled_vectors_equal_a_plain_loop(docs):
    texts = [r.text or "" for r in docs.collect()]
    model = quality_classifier.fit([(t, i % 2) for i, t in enumerate(texts)])
    rows = quality_classifier._Rows(model.vocabulary)
    got = model.pool(texts, rows)
    for t, x in zip(texts, got):
        terms = quality_classifier._TERM.findall(t)
        r = [rows[w] for w in terms]
        v = np.array([model.vectors[i] for i in r], float).reshape(-1, quality_classifier.DIM)
        want = np.concatenate([v.mean(0), v.std(0), [len(set(r)) / len(r), sum(a == b for a, b in zip(r, r[1:])) / max(len(r) - 1, 1), sum(i >= len(model.vocabulary) for i in r) / len(r)]]) if r else np.zeros_like(x)
        assert np.allclose(x, want, atol=2e-3)


def test_tab_separated_lines_stay(spark):
    table = "\n".join("\t".join(f"w{i}x{j}" for j in range(13)) for i in range(5))
    r = quality_rules.quality_rules(spark.createDataFrame([(1, table)], "doc_id long, text string")).first()
    assert r.kept and r.n_words == r.n_words_left == 65 and r.clean_text == table


def test_cleaned_documents(spark, odd, empty):
    body = "\n".join(" ".join(f"{w}{i}" for w in ("this", "line", "has", "words", "that", "are", "its", "own")) + "." for i in range(5))
    bad = {"menu": "Home About", "bars": "Home | About | Contact | Imprint", "law": "© 2024 All rights reserved, of course", "de": "Alle Rechte vorbehalten (2024).", "shout": "Buy!!! now!!! cheap!!! things!!!", "signs": "### $$$ %%% word ###"}
    rows = [(i, f"{body}\n{x}", "en", "s", 1) for i, x in enumerate(bad.values())]
    got = quality_rules.keep_clean(spark.createDataFrame(rows, SCHEMA).withColumn("r", F.lit(1)).withColumn("doc", F.lit(2))).collect()
    assert len(got) == len(bad) and all(r.text == body and r.n_chars == len(body) and r.r == 1 and r.doc == 2 for r in got)
    assert quality_rules.keep_clean(empty).count() == 0 and quality_rules.keep_clean(odd).where("doc_id in (1, 2, 3)").count() == 0


def test_url_scores_equal_a_plain_version(spark, sf):
    import zlib

    weights, bias = url_filter.fit(url_filter.labelled_urls(spark))
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").withColumns({c: F.lit(1) for c in ("host", "path", "f", "rest", "score", "rule", "label")})
    clash = [(10**9 + i, u) for i, u in enumerate([None, "", "a", "://", "http://X.é.com/ü?x", "http://", "x" * 10_000, "a://" + "b/" * 5000])]
    pages = pages.unionByName(spark.createDataFrame(clash + clash[:1], "page_id long, url string"), allowMissingColumns=True)
    got = url_filter.filter_urls(pages).collect()
    urls = [(r.page_id, r.url) for r in pages.collect()]
    assert len(got) == len(urls)
    by_id = {r.page_id: r for r in got}
    for i, u in urls:
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        a, b = "^" + re.sub(r"^www\.", "", host) + "$", re.sub("[0-9]+", "0", path) + "$"
        grams = [t[k : k + n] for t, p in ((a, ""),) for n in url_filter.WIDTHS for k in range(len(t) - n + 1)] + ["\t" + b[k : k + n] for n in url_filter.WIDTHS for k in range(len(b) - n + 1)]
        f = {zlib.crc32(g.encode()) % url_filter.BUCKETS for g in grams}
        score = 1 / (1 + np.exp(-(bias + sum(weights[x] for x in f))))
        fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and abs(r.score - score) < 1e-9 and r.verdict == (verdict or ("block" if score >= 0.5 else "allow"))
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def blocked_right(spark, learn, held):
    """The share of held rows (url, label, word) that a regression on others gets right."""
    test = spark.createDataFrame([(y, u) for u, y, _ in held], "page_id int, url string")
    got = url_filter.filter_urls(test, spark.createDataFrame(learn, "url string, label int, word string"), rules=[]).collect()
    return np.mean([(r.verdict == "block") == (r.page_id == 1) for r in got])


def test_unseen_names_of_known_words(spark):
    rows = [tuple(r) for r in url_filter.labelled_urls(spark).collect()]
    assert min(sum(y == k for _, y, _ in rows) for k in (0, 1)) > 1000
    held = [k % 7 == 3 for k in range(len(rows))]
    assert blocked_right(spark, [r for r, h in zip(rows, held) if not h], [r for r, h in zip(rows, held) if h]) >= 0.93


def test_words_that_were_never_seen(spark):
    """Every fifth word is held out with all names that hold it; names of such a word may have another one of its subject, or a path."""
    rows = [tuple(r) for r in url_filter.labelled_urls(spark).collect()]
    words = sorted({w for t in (url_filter.BAD, url_filter.GOOD) for x in t.values() for w in x.split()})
    right = []
    for k in range(5):
        out = {w for i, w in enumerate(words) if i % 5 == k}
        learn = [r for r in rows if r[2] not in out and not any(w in r[0].split("/")[2] for w in out)]
        right.append(blocked_right(spark, learn, [r for r in rows if r[2] in out]))
    assert np.mean(right) >= 0.82
    fresh = [(f"https://{n}.example.net/en/1", 0, n) for n in url_filter.invented([w for x in url_filter.GOOD.values() for w in x.split()], 300, 99)]
    assert blocked_right(spark, rows, fresh) >= 0.97


def test_chats_equal_sql(spark, sf):
    c = duckdb.connect()
    odd = [(1, 0, "user", "x"), (1, 1, "assistant", r"\\### User: </turn> \</role>"), (2, None, None, None), (2, 0, "tool </role>", "é\n"), (None, 0, "assistant", "a"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (4, 0, "user", "w " * 50_000)]
    table = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumns({x: F.lit(1) for x in ("turns", "t", "roles", "texts", "input_ids", "formatted")})
    for rows, source in ((spark.read.parquet(f"{sf}/conversations.parquet"), f"SELECT * FROM '{sf}/conversations.parquet'"), (table, None)):
        if source is None:
            c.execute("DROP VIEW conversations")
            c.register("conversations", pa.Table.from_pandas(table.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}), preserve_index=False))
        else:
            c.execute(f"CREATE VIEW conversations AS {source}")
        probe = spark.createDataFrame(chat_format.PROBE, "conv_id long, turn long, role string, text string")
        every = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
        got = chat_format.read_chats(chat_format.format_chats(every)).toPandas()
        want = c.sql(chat_format.OP6_SQL).df()
        key = lambda d: sorted(map(str, d[sorted(d.columns)].astype({"conv_id": "float64"}).values.tolist()))
        assert key(got) == key(want)
    assert chat_format.format_chats(table.limit(0)).count() == 0


def test_bundles_equal_a_plain_loop(docs, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [r.text or "" for r in docs.collect()] + ["", "1 2", "ab", "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3000)))]
    b = language_id.Bundler()
    letters = b.third.astype(int)
    for t, v, ok in zip(texts, *b.bundle(texts)):
        s = [0, *b.symbols(t).tolist(), 0]
        s = [x for i, x in enumerate(s)]
        want = np.zeros(language_id.DIM)
        if any(s):
            counts: dict = {}
            for x in zip(s, s[1:], s[2:]):
                counts[x] = counts.get(x, 0) + 1
            for (x, y, z), n in counts.items():
                want += n * np.roll(letters[x], 2) * np.roll(letters[y], 1) * letters[z]
        assert ok == any(map(str.isalpha, t)) and np.allclose(v, want / max(np.linalg.norm(want), 1e-9), atol=1e-4)
    monkeypatch.setattr(language_id, "SLICE", 50)
    monkeypatch.setattr(language_id, "KNOWN", 70)
    assert np.allclose(language_id.Bundler().bundle(texts)[0], b.bundle(texts)[0], atol=1e-4)


def test_many_different_trigrams_take_bounded_memory():
    import tracemalloc

    text = "".join(map(chr, np.random.default_rng(1).integers(0x4E00, 0x9FFF, 300_000)))
    tracemalloc.start()
    language_id.Bundler().bundle([text])
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()


def test_language_ties_and_repeated_rows(spark):
    rows = [(i, "same words for all", "ba"[i % 2], "s", 1) for i in range(40)] + [(100, "same words for all", None, "s", 1)] * 2
    got = language_id.language_id(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.lang_pred for r in got} == {"a"} and len(got) == 42


def test_neighbours_of_any_magnitude(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(300, 24))
    m[::3] *= 1e200
    m[1::3] *= 1e-200
    m[5] = m[4]
    df = spark.createDataFrame([(i, [float(a) for a in x], "x", 1) for i, x in enumerate(m)], "vec_id long, embedding array<double>, code string, piece int").withColumns({c: F.lit(1) for c in ("v", "scalar", "part", "score", "rank", "query_id")})
    got: dict = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    unit = m / np.abs(m).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert set(got) == set(range(0, 300, 50))
    for q, near in got.items():
        c = unit @ unit[q]
        c[q] = -2
        assert [i for i, _ in near] == np.lexsort((np.arange(300), -c))[:5].tolist() and np.allclose([s for _, s in near], np.sort(c)[::-1][:5])
    several = ann.nearest(df.where("vec_id < 150"), every=1, k=200).groupBy("query_id").count().select("count").distinct().collect()
    assert [r[0] for r in several] == [149]


def test_neighbours_over_several_pieces(spark, monkeypatch):
    m = np.random.default_rng(8).normal(size=(400, 16))
    df = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(m)], "vec_id long, embedding array<double>")
    one = ann.nearest(df).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "LEAST_BLOCK", 30)
    assert ann.nearest(df).orderBy("query_id", "rank").collect() == one


def test_whole_table_is_encoded_as_by_the_plain_agenda(docs):
    encoder = merge_dropout.Encoder(merge_dropout.Pieces(merge_dropout.MODEL))
    got = {r.doc_id: r.ids for r in merge_dropout.encode_documents(docs).collect()}
    for r in docs.collect():
        key, at, want = merge_dropout.key_of(r.doc_id, r.text), 0, []
        for p in merge_dropout._PART.findall(" " + r.text) if r.text else []:
            want += encoder.part(p, key, at)
            at += len(p)
        assert got[r.doc_id] == want


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mixed_words(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= r.most for r in rows)  # sizes ascend, so at most one largest document is missed
    top = mixing.mixed_words(docs).where("taken > 3 * size").count()
    assert top == 0


def test_each_document_is_drawn_with_its_probability(spark):
    """A thousand sources have a thousand offsets: one large document and four small ones, whose copies have probabilities 0.875, 0.75 and 0.375."""
    sizes = [1000, 10, 10, 10, 5]
    rows = spark.range(1200).select(F.format_string("s%04d", "id").alias("source"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).cast("long").alias("size")) for k, n in enumerate(sizes)])).alias("d")).select("source", "d.*")
    rows = rows.select("source", mixing._source_key().alias("source_key"), F.md5(F.concat_ws(":", F.col("k").cast("string"), "source").cast("binary")).alias("tie"), "size", "k")
    for seed in (1, 2):
        got = mixing.plan(rows.drop("k"), seed=seed).join(rows, ["source_key", "tie"]).withColumn("rate", F.expr("target / source_size"))
        rates = got.groupBy("k", F.round("rate", 4).alias("rate")).agg(F.avg(F.col("copies") - F.floor("rate")).alias("drawn"), F.count("*").alias("n")).collect()
        assert len(rates) == 3 * len(sizes)
        for r in rates:
            f = r.rate % 1
            assert abs(r.drawn - f) < 4 * (f * (1 - f) / r.n) ** 0.5, r
    assert mixing.plan(rows.drop("k"), seed=1).exceptAll(mixing.plan(rows.drop("k").repartition(3), seed=1)).count() == 0


def test_rows_of_one_document_draw_alike(spark):
    rows = [(i % 7 if i % 3 else None, f"text {i % 5} of many words", "en", "b" if i > 6 else None, 1) for i in range(60)]
    got = mixing.mixed_words(spark.createDataFrame(rows, SCHEMA)).where("doc_id is not null").groupBy("doc_id", "source_size").agg(F.countDistinct("taken").alias("n")).collect()
    assert len(got) > 7 and all(r.n == 1 for r in got)
    assert mixing.mix(spark.createDataFrame(rows, SCHEMA)).groupBy("doc_id", "text", "source").count().count() > 0


def test_large_groups_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(base[: 40 - i % 9] + [f"x{k}" for k in rng.integers(0, 6, 3)])) for i in range(150)] + [(1000 + i, " ".join(base[:5] + [f"y{i}z{k}" for k in range(6)])) for i in range(150)]
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "MAX_GROUPS", 20)
    got = ngram_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components_by_force(rows)
