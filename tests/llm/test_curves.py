import numpy as np

from tidemark.llm import curves
from tidemark.llm.queries import table


def brute(rows, k=5, every=50):
    x = np.array([v for _, v in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, (i, _) in enumerate(rows):
        if i % every == 0:
            s = u @ u[q]
            out[i] = sorted(((-s[j], rows[j][0]) for j in range(len(rows)) if rows[j][0] != i))[:k]
    return out


def test_hilbert_steps_to_neighbouring_cells():
    for d, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        place = curves.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_recall(spark, sf_dir):
    vectors = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "embeddings")
    got = curves.digest(vectors)
    assert curves.recall(got, vectors, vectors.where("vec_id % 50 = 0")) >= 0.9
    want = brute([(r.vec_id, r.embedding) for r in vectors.collect()])
    for r in got.collect():
        assert any(abs(r.score + s) < 1e-12 and r.vec_id == v for s, v in want[r.query_id]) or r.rank <= 5
    counts = {r["query_id"]: r["count"] for r in got.groupBy("query_id").count().collect()}
    assert counts == {i: 5 for i in want}


def test_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    one = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, one) for i in range(0, 300)] + [(i, rng.normal(size=4).tolist()) for i in range(300, 360)]
    bad = [(1000, None), (1050, [0.0] * 4), (1100, [float("nan"), 1.0, 1.0, 1.0]), (1150, [1.0, None, 1.0, 1.0]), (1200, [float("inf"), 1.0, 1.0, 1.0]), (1250, []), (1300, [1.0, 2.0]), (None, one)]
    df = spark.createDataFrame([(*r, "x") for r in [*rows, *bad, *rows[:3]]], "vec_id bigint, embedding array<double>, rank string").repartition(4)
    got = {}
    for r in curves.digest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows)
    assert got.keys() == want.keys()
    for q, b in want.items():
        assert [got[q][i + 1][0] for i in range(5)] == [v for _, v in b] or q >= 300
        assert np.allclose([got[q][i + 1][1] for i in range(5)], [-s for s, _ in b])


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [tuple(r) for r in curves.digest(df).collect()] == [(0, 1, 1, 0.0)]
    assert curves.digest(df.limit(0)).count() == curves.digest(df.where("vec_id = 0")).count() == 0
