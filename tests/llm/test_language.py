import zlib

import numpy as np

from tidemark.llm import language
from tidemark.llm.queries import table


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language.digest(docs).collect()
    assert {r.doc_id: r.held_out for r in got} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in lang}
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    twisted = docs.selectExpr("doc_id", "text", "if(crc32(cast(doc_id as string)) % 4 = 2, 'xx', lang) as lang")
    assert sorted(map(tuple, language.digest(docs).collect())) == sorted(map(tuple, language.digest(twisted).collect()))


def test_mixtures():
    rng = np.random.default_rng(0)
    m = language.Mixture(["a", "b", "c"], np.log(rng.dirichlet(np.full(500, 0.1), 3).T + 1e-9))
    p = np.exp(m.log_p)
    for true in ([1, 0, 0], [0.7, 0.3, 0], [0.4, 0.3, 0.3]):
        n = rng.multinomial(3000, (p @ np.array(true)) / (p @ np.array(true)).sum())
        at = np.flatnonzero(n)
        got = m.proportions(at, n[at])
        assert np.abs(got - true).max() < 0.06 and ((got > 0) == (np.array(true) > 0)).all()


def test_edges(spark):
    rows = [(1, "hello there you", "en"), (2, "hallo du da", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "en"), (None, "hello", None), (1, "hello there you", "en"), (6, "hello " * 200_000, "en")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, text string, lang string, found int")
    got = language.digest(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.lang_pred == "und"} == {i: ("und", 0.0) for i in (3, 4, 5)}
    assert {r.lang_pred for r in language.digest(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {"und"}
    assert language.digest(docs.limit(0)).count() == 0
