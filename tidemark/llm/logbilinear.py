"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, beside add-one word frequencies.

A word's probability is that of its class after the word before, times its share of the class. Each of the most frequent words is
a class; the others are in classes by frequency, and have context vectors of their own, so the vocabulary grows with the
corpus. Spark counts all tokens and all pairs (context, class) as a sparse table. Class vectors are trained on the pairs
summed by the contexts' classes; then each word's context vector is trained on its own pairs, by partitions of the table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, crc_mod
from tidemark.session import written

#: Words that are classes of their own; others share a class with those of like frequency, in which frequencies decide.
VOCABULARY = 1024
#: Words met at least so often have a context vector of their own; rarer ones, and unknown ones, share a class and its vector.
LEAST = 5
#: Steps for a word's context vector, and the weight of its class's vector in observations: one for each unknown.
OWN_STEPS, PRIOR = 40, 24
DIMENSIONS = 24
STEPS = 150
#: Noise words for each word of the corpus. Their expectation is taken exactly, not sampled.
NOISE = 10
#: Tokens whose counts every task gets (some 10 MB); counts of all others are joined in Spark.
HEAD = 200_000
HEAD_BYTES = 64
#: Different tokens, or pairs, that one task gathers before it sends them on.
GATHER = 1 << 20
#: Tokens of a text whose vectors are multiplied at once.
PIECE = 1 << 16
OTHER, EDGE = 0, 1  # the class of all other words; the start of a text as context, its end as a word


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def token_counts(texts: DataFrame) -> DataFrame:
    """``token`` and ``c`` over all of ``texts`` (``body``), without the ends."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[bytes] = Counter()

        def frame():
            out = pd.DataFrame({"token": list(seen.keys()), "c": np.array(list(seen.values()), np.int64)})
            seen.clear()
            return out

        for part in parts:
            for t in part["body"]:
                seen.update(tokens_of(t))
                if len(seen) > GATHER:
                    yield frame()
        yield frame()

    return texts.select("body").mapInPandas(count, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Counts of the most frequent tokens, and the sums over all tokens."""

    place: dict[bytes, int]
    count: np.ndarray
    words: int  # of ``place``, the first so many are classes of their own
    ends: int
    tokens: int
    distinct: int

    def __post_init__(self) -> None:
        named = max(self.words, int((self.count >= LEAST).sum()))
        shared = self.count[self.words : named]
        bands, band = np.unique(np.floor(np.log2(shared)).astype(np.int64), return_inverse=True)
        #: classes: OTHER, EDGE, one for each of the first words, one for each doubling of the counts from LEAST on
        self.size = 2 + self.words + len(bands)
        #: class of each place, and of a token that has none (the last entry)
        unnamed = len(self.count) - named
        self.classes = np.concatenate([np.arange(self.words) + 2, band + 2 + self.words, np.full(unnamed + 1, OTHER)]).astype(np.int64)
        #: words that have a context vector of their own, beside the classes
        self.own = named - self.words
        self.contexts = np.concatenate([np.arange(self.words) + 2, np.arange(self.own) + self.size, np.full(unnamed + 1, OTHER)]).astype(np.int64)
        #: log10 of a word's share of its class; of a token without place only the sum below the line
        sums = np.bincount(band, weights=shared + 1.0, minlength=len(bands))
        rest = np.log10(self.tokens - self.ends - self.count[:named].sum() + self.distinct - min(self.ends, 1) - named + 1)
        self.share = np.concatenate([np.zeros(self.words), np.log10(shared + 1.0) - np.log10(sums)[band], np.log10(self.count[named:] + 1.0) - rest, [-rest]])

    def places(self, tokens: list[bytes]) -> np.ndarray:
        get, none = self.place.get, len(self.count)
        return np.array([get(w, none) for w in tokens], np.int64)


def vocabulary(counts: DataFrame, documents: int, words: int = VOCABULARY, head: int = HEAD) -> Vocabulary:
    """The head is all tokens (of at most HEAD_BYTES) above the least count that leaves at most ``head`` of them."""
    distinct, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    short = counts.where(F.octet_length("token") <= HEAD_BYTES)
    step = F.floor(F.log2("c") * 64)
    bins = short.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bin")).collect()  # at most 64 * 63 rows
    least, seen = None, 0
    for r in bins:
        seen += r["n"]
        if seen > head:
            break
        least = r["bin"]
    rows = short.where(step >= least).toArrow().to_pydict() if least is not None else {"token": [], "c": []}
    order = sorted(zip(rows["c"], rows["token"], strict=True), key=lambda x: (-x[0], x[1]))
    known = int(documents > 0)
    return Vocabulary({bytes(t): i for i, (_, t) in enumerate(order)}, np.array([c for c, _ in order], np.int64), min(words, len(order)), documents, total + documents, distinct + known)


def pair_counts(texts: DataFrame, v: Vocabulary) -> DataFrame:
    """How often each class (``word``) follows each context, over all of ``texts``: ``context``, its class ``parent``, ``word``, ``n``."""
    size = v.size
    parent = np.concatenate([np.arange(size), v.classes[v.words : v.words + v.own]])

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, n = [], 0

        def frame():
            pairs, times = np.unique(np.concatenate(waiting), return_counts=True)
            waiting.clear()
            return pd.DataFrame({"context": pairs // size, "parent": parent[pairs // size], "word": pairs % size, "n": times})

        for part in parts:
            for t in part["body"]:
                at = v.places(tokens_of(t))
                waiting.append(np.concatenate([[EDGE], v.contexts[at]]) * size + np.concatenate([v.classes[at], [EDGE]]))
                n += len(at) + 1
                if n > GATHER:
                    yield frame()
                    n = 0
        if waiting:
            yield frame()

    rows = texts.select("body").mapInPandas(count, "context bigint, parent bigint, word bigint, n bigint")
    return rows.groupBy("context", "parent", "word").agg(F.sum("n").alias("n"))


def class_pairs(pairs: DataFrame, size: int) -> np.ndarray:
    """The pairs summed by the contexts' classes: a square whose size the classes bound."""
    rows = pairs.groupBy("parent", "word").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((size, size))
    out[rows["parent"].to_numpy(), rows["word"].to_numpy()] = rows["n"].to_numpy()
    return out


@dataclass
class LogBilinear:
    """The score of a word is the product of its vector with the context's prediction, plus its bias."""

    contexts: np.ndarray
    mix: np.ndarray
    targets: np.ndarray
    bias: np.ndarray

    def predictions(self) -> tuple[np.ndarray, np.ndarray]:
        """The vector that each context predicts, and the natural log of the sum by which its scores are normalised."""
        predicted = self.contexts @ self.mix
        return predicted, log_sums(predicted, self.targets, self.bias)

    def log10(self, block: int = 256) -> np.ndarray:
        """Normalised log10 probabilities of all words after all contexts, by batches of matrix products."""
        out = np.empty((len(self.contexts), len(self.bias)), np.float32)
        for at in range(0, len(out), block):
            s = (self.contexts[at : at + block] @ self.mix) @ self.targets.T + self.bias
            top = s.max(1, keepdims=True)
            out[at : at + block] = (s - top - np.log(np.exp(s - top).sum(1, keepdims=True))) / np.log(10)
        return out


def log_sums(predicted: np.ndarray, targets: np.ndarray, bias: np.ndarray, block: int = 256) -> np.ndarray:
    out = np.empty(len(predicted))
    for at in range(0, len(out), block):
        s = predicted[at : at + block] @ targets.T + bias
        top = s.max(1)
        out[at : at + block] = top + np.log(np.exp(s - top[:, None]).sum(1, dtype=np.float64))
    return out


def train_contexts(pairs: np.ndarray, start: np.ndarray, model: LogBilinear, freq: np.ndarray, steps: int = OWN_STEPS, noise: int = NOISE, rate: float = 0.1) -> np.ndarray:
    """Predicted vectors of contexts (rows of ``pairs``), by the same objective with the classes' vectors held, drawn to ``start``."""
    p = (freq / freq.sum()).astype(np.float32)
    shift = np.log(noise * p) - model.bias
    total = pairs.sum(1, keepdims=True) + PRIOR
    data = (pairs / total).astype(np.float32)
    both = data + noise * data.sum(1, keepdims=True) * p
    pull = (PRIOR / total).astype(np.float32)
    h, a, b = start.astype(np.float32), np.zeros_like(start, np.float32), np.zeros_like(start, np.float32)
    for t in range(1, steps + 1):
        d = (data - both / (1 + np.exp(shift - h @ model.targets.T))) @ model.targets - pull * (h - start)
        a += 0.1 * (d - a)
        b += 0.01 * (d * d - b)
        h += rate * (1 - t / (steps + 1)) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
    return h


def own_contexts(pairs: DataFrame, v: Vocabulary, model: LogBilinear, freq: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Predicted vectors and log sums of all contexts: classes first, then the words with vectors of their own, trained in Spark."""
    predicted, sums = model.predictions()
    size, wide = v.size, predicted.shape[1]

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for some in (part[i : i + block] for i in range(0, len(part), block)):
                table = np.zeros((len(some), size), np.float32)
                for i, (words, n) in enumerate(zip(some["words"], some["ns"], strict=True)):
                    table[i, words] = n
                h = train_contexts(table, predicted[some["parent"].to_numpy()], model, freq)
                yield pd.DataFrame({"context": some["context"].to_numpy(), "vector": list(h), "log_sum": log_sums(h, model.targets, model.bias)})

    # a context has at most a row for each class
    lists = pairs.where(F.col("context") >= size).groupBy("context", "parent").agg(F.collect_list(F.struct("word", "n")).alias("l"))
    lists = lists.select("context", "parent", F.col("l.word").alias("words"), F.col("l.n").alias("ns"))
    rows = written(lists.mapInPandas(fit, "context bigint, vector array<float>, log_sum double"), "contexts").toArrow()  # at most HEAD rows
    out, out_sums = np.zeros((size + v.own, wide), np.float32), np.zeros(size + v.own)
    out[:size], out_sums[:size] = predicted, sums
    if rows.num_rows:
        at = rows["context"].to_numpy()
        out[at], out_sums[at] = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, wide), rows["log_sum"].to_numpy()
    return out, out_sums


def train(pairs: np.ndarray, dimensions: int = DIMENSIONS, steps: int = STEPS, noise: int = NOISE, rate: float = 0.03, seed: int = 0) -> LogBilinear:
    """Maximises the noise-contrastive objective over the pair table, with unigram noise, by Adam."""
    size, rng = len(pairs), np.random.default_rng(seed)
    freq = pairs.sum(0) + 0.5
    p = (freq / freq.sum()).astype(np.float32)
    total = max(pairs.sum(), 1.0)
    data = (pairs / total).astype(np.float32)
    false = (noise * data.sum(1, keepdims=True) * p).astype(np.float32)  # expected noise pairs
    shift = np.log(noise * p)
    m = LogBilinear(*(rng.normal(0, 0.1, s).astype(np.float32) for s in ((size, dimensions), (dimensions, dimensions), (size, dimensions))), np.log(p))
    m.mix += np.eye(dimensions, dtype=np.float32)
    weights = [m.contexts, m.mix, m.targets, m.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    scale = size  # so that Adam's small constant does not swamp the gradients of rare words
    for t in range(1, steps + 1):
        predicted = m.contexts @ m.mix
        true = 1 / (1 + np.exp(shift - (predicted @ m.targets.T + m.bias)))
        g = (data - (data + false) * true) * scale
        back = g @ m.targets
        grads = [back @ m.mix.T, m.contexts.T @ back, g.T @ predicted, g.sum(0)]
        step = rate * (1 - t / (steps + 1))
        for w, d, a, b in zip(weights, grads, first, second, strict=True):
            a += 0.1 * (d - a)
            b += 0.01 * (d * d - b)
            w += step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-6)
    return m


def scores(docs: DataFrame, training: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_words: int = VOCABULARY, head: int = HEAD) -> DataFrame:
    """A row for each document: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` (log10).

    ``training`` has the documents learned from. A null or empty text is its end alone. Without training documents every
    token is unknown and both scores use the empty counts. Repeated rows are scored each; extra columns take no part.
    """
    learn = training.select(body(F.col(f"`{text}`")).alias("body"))
    counts = written(token_counts(learn), "tokens")
    v = vocabulary(counts, learn.count(), vocabulary_words, head)
    pairs = written(pair_counts(learn, v), "pairs")
    by_class = class_pairs(pairs, v.size)
    model = train(by_class)
    predicted, sums = own_contexts(pairs, v, model, by_class.sum(0) + 0.5)
    base_log = np.log10(v.tokens + v.distinct + 1)
    end_log = np.log10(v.ends + 1)
    id_kind = docs.schema[doc_id].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = len(v.count)
        log_count = np.append(np.log10(v.count + 1), 0.0)
        for part in parts:
            rows = []
            for t in part["body"]:
                tokens = tokens_of(t)
                at = v.places(tokens)
                logs, rare = log_count[at], at == none
                base = float(logs.sum() + end_log - (len(tokens) + 1) * base_log)
                score = float(v.share[at].sum())
                before, words = np.concatenate([[EDGE], v.contexts[at]]), np.concatenate([v.classes[at], [EDGE]])
                for i in range(0, len(words), PIECE):
                    c, w = before[i : i + PIECE], words[i : i + PIECE]
                    natural = np.einsum("ij,ij->i", predicted[c], model.targets[w]).astype(np.float64) + model.bias[w] - sums[c]
                    score += float(natural.sum() / np.log(10))
                few = Counter(tokens[i] for i in np.flatnonzero(rare).tolist())
                rows.append((len(tokens) + 1, len(tokens) - int(rare.sum()) + int(v.ends > 0), base, score, [{"token": k, "n": n} for k, n in few.items()]))
            yield pd.concat([part[["row", "doc_id"]], pd.DataFrame(rows, columns=["n_tokens", "n_known", "base", "score", "rare"], index=part.index)], axis=1)

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), body(F.col(f"`{text}`")).alias("body"))
    seen = written(source.mapInPandas(run, f"row bigint, doc_id {id_kind}, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<token: binary, n: bigint>>"), "scored")
    rare = seen.select("row", F.explode("rare").alias("r")).select("row", "r.token", "r.n")
    # tokens outside the head; each of them has a count below the head's, so no key is hot
    more = rare.join(counts, "token").groupBy("row").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("logs"))
    whole = seen.drop("rare").join(more.withColumnRenamed("row", "of"), F.col("row") == F.col("of"), "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return whole.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(v.tokens)).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def digest(docs: DataFrame, parts: int = 7, held: int = 2) -> DataFrame:
    """Learns from documents whose id's crc32 is not 2 modulo 7; null ids are learned from."""
    narrow = docs.select("doc_id", "text")
    out = F.coalesce(crc_mod("doc_id", parts) == held, F.lit(False))
    scored = scores(narrow, narrow.where(~out))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
