"""The stages against plain loops, and with odd rows."""

import re

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_secret_scan import ASSIGN
from tests.llm.test_simhash import brute as components
from tests.llm.test_simhash import plain_fingerprint
from tidemark.llm import quality
from tidemark.llm.queries import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    good = stage[names[0]](spark, docs, sf_dir)
    kept = {r.doc_id for r in quality.digest(docs, table(spark, sf_dir, "labels")).where("kept").collect()}
    assert good.columns == COLUMNS and {r.doc_id for r in good.collect()} == kept
    one = stage[names[1]](spark, good, sf_dir)
    texts = {r.doc_id: r.text for r in good.collect()}
    groups = components({i: plain_fingerprint(t) for i, t in texts.items()})
    assert one.columns == COLUMNS and {r.doc_id for r in one.collect()} == set(groups.values())
    clean = stage[names[2]](spark, one, sf_dir)
    hit = {r[0] for r in contaminated([(r.doc_id, r.text) for r in one.collect()], [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]) if r[-1]}
    assert clean.columns == COLUMNS and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - hit
    safe = stage[names[3]](spark, clean, sf_dir)
    assert safe.columns == COLUMNS and safe.count() == clean.count()
    for r in safe.collect():
        assert r.n_chars == len(r.text)
        assert not any(len(m[2]) >= 6 for m in ASSIGN.finditer(r.text)) and not re.search("[0-9a-f]{24}", r.text)
    packed = stage[names[4]](spark, safe, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in safe.collect()}


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and "ids" in out.columns


def test_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "s", None), (2, "", None, None, 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15), (None, "other words", None, "s", 11), (4, "long " * 50_000, "en", "s", 250_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as _row", "2 as sequence_id", "3 as component_id")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, some, sf_dir)
            assert got.columns == docs.columns, name
            assert got.count() <= some.count()
        corpus_pipeline.STAGES[-1][1](spark, some, sf_dir).collect()
    assert [r.n_chars for r in dict(corpus_pipeline.STAGES)["secret_scan"](spark, docs.where("doc_id = 1"), sf_dir).collect()] == [None]
