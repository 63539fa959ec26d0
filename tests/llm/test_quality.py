import numpy as np

from tidemark.llm import quality
from tidemark.llm.queries import table


def test_kth_largest_is_exact(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=3000), rng.integers(0, 4, 3000).astype(float), np.exp(rng.normal(0, 9, 3000)), np.zeros(50)):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        want = sorted(values, reverse=True)
        for k in (1, 2, 40, len(values) // 2, len(values)):
            assert quality.kth_largest(df, "v", k, bins=7, enough=5) == want[k - 1]
    assert quality.kth_largest(df, "v", 0) == float("inf")


def test_scores_against_a_plain_version(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    good = {r.doc_id: r.quality == 1 for r in labels.collect()}
    own = {i: np.bincount(np.concatenate(list(quality.buckets_of(t, quality.BUCKETS))), minlength=quality.BUCKETS) for i, t in texts.items()}
    raw, fine = sum(own.values()), sum(n for i, n in own.items() if good.get(i))
    ratio = {}
    for i, n in own.items():
        p, q = fine - n * good.get(i, False) + 1.0, raw - n + 1.0
        ratio[i] = n @ np.log((p / p.sum()) / (q / q.sum())) / n.sum()
    got = {r.doc_id: r for r in quality.digest(docs, labels).collect()}
    assert got.keys() == ratio.keys()
    assert max(abs(got[i].log_ratio - x) for i, x in ratio.items()) < 1e-9
    least = min(r.key for r in got.values() if r.kept)
    assert all(r.key < least for r in got.values() if not r.kept)
    share = lambda y, k: np.mean([got[i].kept == k for i, g in good.items() if g == y])
    assert share(True, True) > 0.98 and share(False, False) > 0.9


def test_sample_of_k(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out, name, least = quality.resample(docs, labels, k=50)
    assert out.where(quality.kept(name, least)).count() == 50


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "good text", 1), (3, "good text", 1), (3, "good text", 1), (4, "b*d " * 100_000, 1)], "doc_id bigint, text string, _importance int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (None, 1), (1, None)], "doc_id bigint, quality int")
    out, name, least = quality.resample(docs, labels)
    assert name == "_importance_" and out.columns[:3] == docs.columns
    kept = out.where(quality.kept(name, least))
    assert out.count() == 6 and kept.where("doc_id = 3").count() == 2 and kept.where("doc_id = 4").count() == 0
    assert quality.digest(docs, labels.limit(0)).where("kept").count() == 6  # nothing to tell by
    assert quality.digest(docs.limit(0), labels).count() == 0
