"""The pipeline against a plain version of each stage on the stage's own input."""

import corpus_pipeline
from tempograph.llm import merge_dropout, mixing, pii

from .test_operators import components_by_force


def test_pipeline_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    by_id = lambda rows: {r.doc_id: r.text for r in rows}
    given, kept = by_id(inputs["quality_rules"]), by_id(inputs["ngram_jaccard_join"])
    assert 0 < len(kept) < len(given) and all(set(t.split("\n")) <= set(given[i].split("\n")) for i, t in kept.items())
    comps = components_by_force(sorted(kept.items()))
    assert set(by_id(inputs["pii"])) == {i for i, (_, c) in comps.items() if i == c}
    for i, t in by_id(inputs["mixing"]).items():
        b, a = pii.find_spans([kept[i]])[0]
        assert t == pii.masked(kept[i], b + a)
    rows = [(r.doc_id, r.text) for r in inputs["sentencepiece"]]
    assert len(rows) == mixing.mix(spark.read.parquet(f"{tmp_path}/pii")).count()
    back = {r.doc_id: r.text for r in merge_dropout.decode_documents(docs).collect()}
    assert back == dict(rows) and docs.count() == len(rows) and docs.where("not decodes").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == len(rows)


def test_copies_of_the_mix_are_encoded_by_their_own_draws(spark, sf):
    text = "unbelievable tokenization of words " * 50
    docs = spark.createDataFrame([(1, text, "en", "a", 1)] * 3 + [(2, text, "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [[tuple(r.ids) for r in corpus_pipeline.encoding_stage(spark, docs, sf).collect()] for _ in range(2)]
    assert len(set(got[0])) == 4 and sorted(got[0]) == sorted(got[1])


def test_stages_on_odd_rows_and_empty_tables(spark, sf):
    shape = "doc_id long, text string, lang string, source string, n_chars long, copy string, ids int, key string, doc string"
    long = " ".join(f"word{i} is here." for i in range(3000))
    body = "A text of more than ten words that says nothing in particular, to {} or to others."
    rows = [(1, None, None, None, None), (None, body.format("a@b.de"), "en", None, 3), (None, body.format("a@b.de"), "en", None, 3), (2, "", "en", "a", 0), (3, " \n\t", "de", None, 3), (4, long, "en", "b", None), (4, long, "en", "b", None), (5, body.format("whom"), "en", "a", 1)]
    docs = spark.createDataFrame([(*r, "x", 1, "k", "d") for r in rows], shape)
    for start in (docs, docs.limit(0)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = spark.createDataFrame(stage(spark, at, sf).collect(), at.schema) if name != "sentencepiece" else stage(spark, at, sf)
        out = at.collect()
        assert all(r.decodes for r in out) and (len(out) > 0) == (start is docs)
        assert {r.doc_id for r in out} <= {None, 4, 5}
