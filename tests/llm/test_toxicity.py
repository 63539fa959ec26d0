import random

import numpy as np

from tidemark.llm import toxicity
from tidemark.llm.queries import table


def index_of(texts, labels):
    index = toxicity.Index(np.array(labels))
    terms = {w for t in texts for w in toxicity.words_of(t)}
    index.idf = {w: 1.0 + sum(w in toxicity.words_of(t) for t in texts) ** -0.5 for w in terms}
    index.build([index.vector(t) for t in texts])
    return index


def test_nearest_is_exact():
    rnd = random.Random(0)
    words = [f"w{i}".encode() for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = [b" ".join(rnd.choices(words, weights, k=rnd.randint(1, 12))) for _ in range(900)]
    index = index_of(texts, [i % 2 for i in range(900)])
    vectors = [index.vector(t) for t in texts]
    for _ in range(200):
        q = index.vector(b" ".join(rnd.choices(words, weights, k=rnd.randint(1, 20))))
        all_ = np.array([sum(x * v.get(w, 0.0) for w, x in q.items()) for v in vectors])
        want = sorted(np.flatnonzero(all_ > 0), key=lambda i: (-round(all_[i], 12), i))[:10]
        near, cosines = index.nearest(q, k=10)
        assert near.tolist() == want
        assert np.allclose(cosines, all_[want])


def test_held_out(spark, sf_dir):
    docs, labels = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), table(spark, sf_dir.replace("sf0.001", "sf0.01"), "labels")
    got = {r.doc_id: r for r in toxicity.digest(docs, labels).collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(got[i].score, y) for i, y in toxic.items() if got[i].held_out]
    hits = [s for s, y in held if y] and np.mean([s >= 0.5 for s, y in held if y])
    assert hits > 0.5 and np.mean([s < 0.5 for s, y in held if not y]) > 0.97


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "you idiot"), (4, "nice day"), (4, "nice day"), (None, "idiot"), (5, "idiot " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, found int")
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (5, None), (None, 1)], "doc_id bigint, toxic int")
    for some in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.digest(docs, some).collect()
        assert len(got) == len(rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.digest(docs.limit(0), labels).count() == 0


def test_rare_insults_and_copies(spark):
    """Every term is searched: an insult of two examples, and a copy of an example without any marked term, are found."""
    rnd = random.Random(1)
    text = lambda n: " ".join(f"w{rnd.randint(0, 3000)}" for _ in range(n))
    copied = text(40)
    rows = [(i, text(40), 0) for i in range(300)] + [(300 + i, "you snollygoster " + text(4), 1) for i in range(2)] + [(302, copied, 1)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    index = toxicity.fit(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    # every word of every example, and its beginnings
    assert {x for _, t, _ in rows for w in t.encode().split() for x in toxicity.terms_of(w)} == set(index.place)
    asked = [copied, "what a snollygoster", text(40)]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string").coalesce(1)
    got = [r.found for r in docs.select("doc_id", toxicity.scores(docs["text"], index).alias("found")).orderBy("doc_id").collect()]
    assert got[0].labels[0] == 1 and abs(got[0].cosines[0] - 1) < 1e-9
    assert got[0].score >= 0.5 and got[1].score >= 0.5 and got[2].score < 0.5


def test_settings_are_compared_by_folds_of_the_examples(spark):
    """A fold is scored by an index of the others, as a plain loop over the folds says; rows without a label take no part."""
    rnd = random.Random(2)
    text = lambda n: " ".join(f"w{rnd.randint(0, 400)}" for _ in range(n))
    rows = [(i, text(12) + (" you snollygoster" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(80)] + [(100, text(9), None)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    found = toxicity.sample(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    assert len(found.texts) == 80 and found.totals.tolist() == [60, 20]
    got = toxicity.fold_losses(found, [(0.0, 0.1), (10.0, 0.2)])
    assert got["found"][1] >= got["found"][0] and got["log_loss"][1] < got["log_loss"][0]
    loss = []
    for f in range(5):
        others = [r for i, r in enumerate(found.texts) if i % 5 != f]
        part = toxicity.Examples(others, found.totals, found.place, found.idf)
        index = part.index(np.arange(len(others)), 10.0, 0.2)
        for t, y in found.texts[f::5]:
            s = index.scores([index.row(t)])[0][0]
            loss.append(-np.log(max(s if y else 1 - s, 1e-6)))
    assert abs(np.mean(loss) - got["log_loss"][1]) < 1e-9
