import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import logbilinear
from tidemark.llm.common import body
from tidemark.llm.queries import table


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in low.encode().decode().translate({i: " " for i in range(9, 14)}).split(" ") if w] + [b""]


@pytest.mark.parametrize("head", [logbilinear.HEAD, 50])
def test_base_scores(spark, sf_dir, head, monkeypatch):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    c = Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    train = docs.where("crc32(cast(doc_id as string)) % 7 <> 2")
    got = {r.doc_id: r for r in logbilinear.scores(docs, train, vocabulary_words=40, head=head).collect()}
    for i, t in rows:
        w = tokens(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)


def test_probabilities_are_normalised_and_learned():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.full(30, 0.2), 30)
    pairs = rng.multinomial(200_000, (p / 30).ravel()).reshape(30, 30).astype(float)
    table_ = logbilinear.train(pairs, dimensions=12, steps=400).log10()
    assert np.allclose((10 ** table_.astype(float)).sum(1), 1, atol=1e-4)
    unigram = np.log10(pairs.sum(0) / pairs.sum())
    assert (pairs * table_).sum() / pairs.sum() > (pairs * unigram).sum() / pairs.sum() + 0.1


def fitted(docs, words, head):
    learn = docs.select(body("text").alias("body"))
    counts = logbilinear.token_counts(learn)
    v = logbilinear.vocabulary(counts, learn.count(), words, head)
    pairs = logbilinear.pair_counts(learn, v)
    by_class = logbilinear.class_pairs(pairs, v.size)
    model = logbilinear.train(by_class)
    predicted, sums = logbilinear.own_contexts(pairs, v, model, by_class.sum(0) + 0.5)
    return {bytes(r.token): r.c for r in counts.collect()}, v, pairs, model, predicted, sums


@pytest.mark.parametrize("head", [logbilinear.HEAD, 200])
def test_scores_are_those_of_a_plain_version(spark, sf_dir, head):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts, v, pairs, model, predicted, sums = fitted(docs, 40, head)
    assert v.own > 50 and len(predicted) == v.size + v.own

    plain = Counter()
    rows = docs.collect()
    for r in rows:
        at = v.places(tokens(r.text)[:-1])
        plain.update(zip([1, *v.contexts[at]], [*v.classes[at], 1], strict=True))
    assert {(r.context, r.word): r.n for r in pairs.collect()} == plain

    frequent = {w for w, i in v.place.items() if v.classes[i] != 0}
    other = sum(c + 1 for w, c in counts.items() if w not in frequent) + 1  # and the unknown word
    in_class = Counter()
    for w in frequent:
        in_class[v.classes[v.place[w]]] += counts[w] + 1

    def share(w):
        if w not in frequent:
            return (counts.get(w, 0) + 1) / other
        return 1.0 if v.place[w] < v.words else (counts[w] + 1) / in_class[v.classes[v.place[w]]]

    assert math.isclose(sum(share(w) for w in counts) + share(b"never met"), v.size - 1, rel_tol=1e-9)  # one for each class but the end
    p = np.exp(predicted.astype(float) @ model.targets.T + model.bias - sums[:, None])
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    got = {r.doc_id: r.score for r in logbilinear.scores(docs, docs, vocabulary_words=40, head=head).collect()}
    for r in rows[:60]:
        words = tokens(r.text)[:-1]
        at = v.places(words)
        steps = zip([1, *v.contexts[at]], [*v.classes[at], 1], strict=True)
        want = sum(math.log10(p[c, w]) for c, w in steps) + sum(math.log10(share(w)) for w in words)
        assert math.isclose(got[r.doc_id], want, rel_tol=1e-4)


def test_contexts_grow_with_the_corpus_and_cover_most_tokens_met_often(spark, sf_dir):
    own = []
    for sf in (sf_dir, sf_dir.replace("sf0.001", "sf0.01")):
        docs = table(spark, sf, "documents").select(body("text").alias("body"))
        counts = logbilinear.token_counts(docs)
        v = logbilinear.vocabulary(counts, docs.count())
        assert v.own + v.words == counts.where(f"c >= {logbilinear.LEAST}").count()
        own.append(v.own)
    assert own[1] > 3 * max(own[0], 1)


def test_a_word_learns_its_own_context():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(20, 0.2), 21)
    pairs = rng.multinomial(100_000, (p[:20] / 20).ravel()).reshape(20, 20).astype(float)
    model = logbilinear.train(pairs, dimensions=12, steps=400)
    start, _ = model.predictions()
    some = rng.multinomial(2_000, p[20])[None, :].astype(float)
    h = logbilinear.train_contexts(some, start[:1], model, pairs.sum(0) + 0.5)

    def mean(vector):
        logs = vector @ model.targets.T + model.bias - logbilinear.log_sums(vector, model.targets, model.bias)[:, None]
        return float((p[20] * logs[0]).sum())

    assert mean(h) > mean(start[:1]) + 0.1
    nothing = logbilinear.train_contexts(np.zeros((1, 20)), start[:1], model, pairs.sum(0) + 0.5)
    assert np.allclose(nothing, start[:1], atol=1e-5)


def test_score_beats_frequencies_on_held_out_documents(spark, sf_dir):
    got = logbilinear.digest(table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert all(r.score < 0 for r in got)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b a"), (3, "a b a"), (None, "a zz"), (5, "a" * 100_000), (6, "b " * 100_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, row int")
    for train in (docs, docs.limit(0)):
        got = logbilinear.scores(docs, train).collect()
        assert len(got) == len(rows)
        assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert logbilinear.digest(docs.limit(0)).count() == 0
