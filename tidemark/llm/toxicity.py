"""Toxicity by nearest labelled examples: exact TF-IDF cosine over all terms of the examples, by block-max indexes, and distance-weighted votes."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import sqrt
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, crc_mod, labelled

#: Labelled rows of either label that are kept as examples: the classifier is fitted on a sample of at most twice this many.
EXAMPLES = 2000
#: Examples that vote, block length of the posting lists.
NEIGHBOURS = 25
BLOCK = 64
#: A term counts 1 + min(z / SIGMAS, 1) ** 2 * BOOST times its idf, where the labels' shares of documents with it differ by z
#: standard errors. No term is left out.
SIGMAS = 5.0
BOOST = 10.0
#: Votes fall by e for so much less cosine. Both constants are those of least log loss in ``fold_losses`` over learning rows.
BANDWIDTH = 0.2
#: Terms of more than this share of the examples are kept as dense columns.
COMMON = 0.05
#: Besides words, their beginnings of so many bytes are terms, so that other endings of a word are met.
STEMS = (4, 5)
#: Texts searched for by one product.
BATCH = 128
#: Words whose terms a task remembers.
CACHE_WORDS = 200_000
#: Fixed by the definition of a term: lower-cased A-Z, digits and everything outside ASCII.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings with a mark that no word has."""
    return [word, *(word[:n] + b"*" for n in STEMS if len(word) > n)]


@dataclass
class Index:
    """Examples as unit TF-IDF vectors over all their terms.

    Rare terms have lists of examples and weights, end to end; common ones are dense columns by example, with the largest
    weight in each block of examples.
    """

    labels: np.ndarray
    idf: dict[bytes, float] = field(default_factory=dict)
    place: dict[bytes, int] = field(default_factory=dict, repr=False)
    factor: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64), repr=False)
    examples: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32), repr=False)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32), repr=False)  # of each term, -1 if it is rare
    common: tuple[np.ndarray, ...] = field(default=(), repr=False)  # examples, columns and weights of common terms
    laid: tuple[np.ndarray, ...] = field(default=(), repr=False)  # dense columns, block maxima, single precision; made by each worker
    known: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)
    prior: float = 0.0
    blank: float = 0.0
    bandwidth: float = BANDWIDTH
    scale: np.ndarray = field(default_factory=lambda: np.ones(2))

    def row(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the text's terms that any example has, and the unit TF-IDF vector over them: (1 + log of the count) times idf."""
        if self.idf and not self.place:
            self.place = {w: i for i, w in enumerate(self.idf)}
            self.factor = np.array(list(self.idf.values()))
        place, known = self.place, self.known
        ids: list[int] = []
        counts: list[int] = []
        sizes: list[int] = []
        for w, n in Counter(words_of(text)).items():
            terms = known.get(w)
            if terms is None:
                terms = tuple(place[t] for t in terms_of(w) if t in place)
                if len(known) < CACHE_WORDS:
                    known[w] = terms
            if terms:
                ids += terms
                counts.append(n)
                sizes.append(len(terms))
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0)
        at, of = np.unique(np.array(ids), return_inverse=True)
        x = (1 + np.log(np.bincount(of, np.repeat(counts, sizes)))) * self.factor[at]
        return at, x / sqrt(x @ x)

    def vector(self, text: bytes | None) -> dict[bytes, float]:
        """``row`` by term. Empty if the text has no term of the examples."""
        at, x = self.row(text)
        names = list(self.place)
        return {names[i]: v for i, v in zip(at.tolist(), x.tolist(), strict=True)}

    def build(self, vectors: list[dict[bytes, float]]) -> None:
        self.row(None)
        self.fill([(np.array([self.place[w] for w in v], np.int64), np.array(list(v.values()))) for v in vectors])

    def fill(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        terms, n = len(self.place), len(rows)
        at = np.concatenate([np.zeros(0, np.int64), *(r[0] for r in rows)])
        x = np.concatenate([np.zeros(0), *(r[1] for r in rows)])
        of = np.repeat(np.arange(n, dtype=np.int32), [len(r[0]) for r in rows])
        length = np.bincount(at, minlength=terms)
        common = length > max(COMMON * n, 1)
        self.column = np.where(common, np.cumsum(common) - 1, -1).astype(np.int32)
        mine = common[at]
        self.common, self.laid = (of[mine], self.column[at[mine]], x[mine]), ()
        at, x, of = at[~mine], x[~mine], of[~mine]
        order = np.argsort(at, kind="stable")
        self.examples, self.weights = of[order], x[order]
        self.starts = np.concatenate([[0], np.cumsum(np.where(common, 0, length))])

    def lay(self) -> tuple[np.ndarray, ...]:
        if not self.laid:
            of, column, x = self.common
            dense = np.zeros((len(self.labels), int(self.column.max(initial=-1)) + 1))
            dense[of, column] = x
            self.laid = (dense, np.maximum.reduceat(dense, np.arange(0, len(dense), BLOCK), axis=0), dense.T.astype(np.float32))
        return self.laid

    def nearest(self, v: dict[bytes, float], k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        known = [(self.place[w], x) for w, x in v.items() if w in self.place]
        return self.search([(np.array([i for i, _ in known], np.int64), np.array([x for _, x in known]))], k, [skip])[0]

    def search(self, rows: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row the ``k`` examples of largest cosine (over 0) and their cosines, exactly; ties to the smaller number.

        Rare terms are taken first, from their lists. What common terms can add at most is known from the block maxima;
        an example that cannot reach the k-th best so far by that much is out. Rows with many examples left get the
        common part by one product in single precision, which leaves those near the k-th. Cosines of what is left are
        added up in double precision.
        """
        n = len(self.labels)
        dense, tops, single = self.lay()
        wide, lists = np.zeros((len(rows), dense.shape[1])), []
        for i, (at, x) in enumerate(rows):
            column = self.column[at]
            rare = column < 0
            wide[i, column[~rare]] = x[~rare]
            first = self.starts[at[rare]]
            size = self.starts[at[rare] + 1] - first
            places = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            sums = np.bincount(self.examples[places], self.weights[places] * np.repeat(x[rare], size), n).astype(float)  # of nothing it counts in integers
            if skip and skip[i] >= 0:
                sums[skip[i]] = -np.inf
            lists.append(sums)
        most = np.repeat(wide @ tops.T, BLOCK, axis=1)[:, :n]
        able = [np.flatnonzero(s + m >= _kth(s, k) - 1e-12) for s, m in zip(lists, most, strict=True)]
        many = [i for i, left in enumerate(able) if len(left) > n / 8]
        about = wide[many].astype(np.float32) @ single
        for i, part in zip(many, about, strict=True):
            part = lists[i] + part
            able[i] = np.flatnonzero(part >= _kth(part, k) - 1e-5)
        out = []
        for sums, left, row in zip(lists, able, wide, strict=True):
            cosines = sums[left] + dense[left] @ row
            left, cosines = left[cosines > 0], cosines[cosines > 0]
            best = np.lexsort((left, -cosines.round(12)))[:k]
            out.append((left[best], cosines[best]))
        return out

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Share of label 1 among the neighbours, each weighted by its nearness and by how rare its label's examples were made."""
        none = (np.zeros(0, np.int64), np.zeros(0))
        if not len(self.labels):
            return [(0.0, *none)] * len(rows)
        if not self.place:
            return [(self.blank, *none)] * len(rows)
        out = []
        # one vote of the prior with the weight of an example at no nearness
        ground = float(np.exp(-1 / self.bandwidth))
        for row, (near, cosines) in zip(rows, self.search(rows), strict=True):
            weight = np.exp((cosines - 1) / self.bandwidth) * self.scale[self.labels[near]]
            total, toxic = weight.sum(), weight[self.labels[near] == 1].sum()
            out.append((float((toxic + ground * self.prior) / (total + ground)), near, cosines) if len(row[0]) else (self.blank, *none))
        return out


def _kth(x: np.ndarray, k: int) -> float:
    return np.partition(x, -k)[-k] if len(x) > k else -np.inf


def document_counts(bodies: DataFrame, place: dict[bytes, int]) -> np.ndarray:
    """In how many of all texts (``body``) each term of ``place`` stands."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, tuple[int, ...]] = {}
        total = np.zeros(len(place), np.int64)
        for part in parts:
            for t in part["body"]:
                mine: set[int] = set()
                for w in set(words_of(t)):
                    found = known.get(w)
                    if found is None:
                        found = tuple(place[x] for x in terms_of(w) if x in place)
                        if len(known) < CACHE_WORDS:
                            known[w] = found
                    mine.update(found)
                total[list(mine)] += 1
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": some, "n": total[some]})

    rows = bodies.select("body").mapInPandas(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(place), np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


def _sample(marked: DataFrame, label: int, n: int, rows: int) -> list[tuple[bytes | None, int]]:
    """Of the ``rows`` of a label, ``n`` different texts with the smallest hashes: the same in any partitioning.

    Most rows are left out by their hash before equal ones are united; if too few texts are left, as there are many
    copies, all are taken in.
    """
    some = marked.where(F.col("_label") == label)
    for share in (4.0 * n / max(rows, 1), 1.0):
        near = some if share >= 1 else some.where(F.shiftrightunsigned("h", 11) < int(share * (1 << 53)))
        found = near.groupBy("h").agg(F.min("body").alias("body")).orderBy(F.shiftrightunsigned("h", 11), "h").limit(n).collect()
        if len(found) == n:
            break
    return [(r["body"] and bytes(r["body"]), label) for r in found]


def unalike(texts: list[tuple[bytes | None, int]], n: int) -> list[tuple[bytes | None, int]]:
    """The first ``n`` texts that are no near copies of earlier ones: none of four least hashes of five-word shingles is shared.

    Else a term that one group of copies happens to hold would look like a mark of its label.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for text, label in texts:
        words = words_of(text)
        shingles = {crc32(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))}
        h = np.array(list(shingles), np.uint64)
        marks = {(i, int((h * np.uint64(a) % np.uint64(4294967291)).min())) for i, a in enumerate((1, 2654435761, 2246822519, 3266489917))}
        if not marks & seen:
            out.append((text, label))
        seen |= marks
        if len(out) == n:
            break
    return out


@dataclass
class Examples:
    """A bounded sample of labelled texts, with what all documents say of their terms."""

    texts: list[tuple[bytes | None, int]]
    totals: np.ndarray  # labelled documents of either label
    place: dict[bytes, int] = field(default_factory=dict, repr=False)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(0), repr=False)

    def terms(self, at: np.ndarray) -> np.ndarray:
        """In how many of the texts ``at`` of either label each term stands."""
        out = np.zeros((2, len(self.place)), np.int64)
        for i in at.tolist():
            text, label = self.texts[i]
            out[label, list({self.place[x] for w in set(words_of(text)) for x in terms_of(w)})] += 1
        return out

    def index(self, at: np.ndarray, boost: float = BOOST, bandwidth: float = BANDWIDTH) -> Index:
        """The texts ``at`` as an index. Contrasts between the labels are taken from these texts alone."""
        index = Index(np.array([self.texts[i][1] for i in at.tolist()], np.int64), bandwidth=bandwidth)
        kept = np.bincount(index.labels, minlength=2).astype(float)
        if not kept.all():
            index.prior = index.blank = float(kept[1] > 0)
            return index
        index.scale = self.totals / kept  # an example stands for so many labelled documents
        index.prior = float(self.totals[1] / self.totals.sum())
        a = self.terms(at)
        p, pooled = a / kept[:, None], a.sum(0) / kept.sum()
        z = np.abs(p[0] - p[1]) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / kept).sum())
        index.place, index.factor = self.place, self.idf * (1 + boost * np.minimum(z / SIGMAS, 1) ** 2)
        vectors = [index.row(self.texts[i][0]) for i in at.tolist()]
        index.fill(vectors)
        index.known.clear()
        empty = np.bincount([y for v, y in zip(vectors, index.labels.tolist(), strict=True) if not len(v[0])], minlength=2) * index.scale
        index.blank = float((empty[1] + index.prior) / (empty.sum() + 1))
        return index


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES, seed: int = 11) -> Examples:
    """At most ``examples`` labelled texts of either label that are no near copies of each other, with idf from all of ``docs``.

    A document with several labels has the smallest; null labels are left out.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body(F.col(f"`{text}`")).alias("body"))
    named = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("label"))
    marked = labelled(source, named, "label").where("_label is not null").withColumn("h", F.xxhash64("body", F.lit(seed)))
    totals = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [x for y in (0, 1) for x in unalike(_sample(marked, y, 2 * examples, totals.get(y, 0)), examples)]
    out = Examples(rows, np.array([totals.get(0, 0), totals.get(1, 0)], float))
    if len({y for _, y in rows}) == 2:
        for t, _ in rows:
            for w in dict.fromkeys(words_of(t)):
                for x in terms_of(w):
                    out.place.setdefault(x, len(out.place))
        out.idf = np.log(1 + source.count() / np.maximum(document_counts(source, out.place), 1))
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", examples: int = EXAMPLES, seed: int = 11) -> Index:
    """An index over a bounded ``sample`` of labelled documents.

    Every term of an example is in the index, with its idf from the counts over all of ``docs``; terms that the two labels
    use in different shares of their examples count more.
    """
    found = sample(docs, labels, doc_id, text, label, examples, seed)
    return found.index(np.arange(len(found.texts)))


def fold_losses(found: Examples, settings: list[tuple[float, float]], folds: int = 5) -> pd.DataFrame:
    """For each (boost, bandwidth): log loss of the examples, each scored by an index of the other folds, and the shares
    of toxic ones found and of others cleared. An example weighs as the labelled documents that it stands for.

    This chooses ``BOOST`` and ``BANDWIDTH`` by learning rows alone; held-out rows are for the report afterwards.
    """
    n, y = len(found.texts), np.array([label for _, label in found.texts])
    weight = (found.totals / np.bincount(y, minlength=2))[y]
    rows = []
    for boost, bandwidth in settings:
        got = np.zeros(n)
        for f in range(folds):
            mine, at = np.arange(n) % folds == f, np.arange(n)
            index = found.index(at[~mine], boost, bandwidth)
            for i in range(0, mine.sum(), BATCH):
                part = at[mine][i : i + BATCH]
                got[part] = [s for s, _, _ in index.scores([index.row(found.texts[j][0]) for j in part.tolist()])]
        p = np.clip(np.where(y == 1, got, 1 - got), 1e-6, 1)
        right = (got >= 0.5) == (y == 1)
        rows.append((boost, bandwidth, float(np.average(-np.log(p), weights=weight)), float(right[y == 1].mean()), float(right[y == 0].mean())))
    return pd.DataFrame(rows, columns=["boost", "bandwidth", "log_loss", "found", "cleared"])


def scores(text: Column, index: Index) -> Column:
    """``score`` (0 to 1) and, as evidence, the nearest examples' numbers, cosines and labels. A text without terms has the share of such examples."""

    @F.pandas_udf("score double, examples array<int>, cosines array<double>, labels array<int>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for at in range(0, len(texts), BATCH):
                found = index.scores([index.row(t) for t in texts.iloc[at : at + BATCH]])
                rows += [(score, near.tolist(), cosines.tolist(), index.labels[near].tolist()) for score, near, cosines in found]
            yield pd.DataFrame(rows, columns=["score", "examples", "cosines", "labels"])

    return of.asNondeterministic()(body(text))


def digest(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0) -> DataFrame:
    """Learns from labelled documents whose id's crc32 is not 0 modulo 5. A null id has no label."""
    out = F.coalesce(crc_mod("doc_id", parts) == held, F.lit(False))
    index = fit(docs.where(~out), labels)
    found = docs.select("doc_id", out.alias("held_out"), scores(F.col("text"), index).alias("found"))
    score = F.col("found.score")
    return found.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
