"""Quality by importance resampling: hashed n-gram models of good and of all text, and a Gumbel top-k sample by their ratio."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, fresh, labelled, plain
from tidemark.session import written

BUCKETS = 1 << 14
#: Added to each bucket's count in both models.
SMOOTHING = 1.0
SEED = 7
#: Exponent of a document's importance (the geometric mean over its n-grams) in the sample.
SHARPNESS = 64.0
#: A lower cut is taken if no more than this share of the bad documents passes for it, as lost good ones cost more.
LENIENCE = 0.01
#: Bytes taken at a time.
BLOCK = 1 << 20
#: Buckets kept for patterns of repeated words: which of three neighbouring words equal the one before.
REPEATS = 8


def buckets_of(text: bytes | None, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a text (cased, so that shouting shows) and of its patterns of repeated words, block by block."""
    text = text or b""
    words = text.split()
    if not words:
        return
    raw = np.frombuffer(b" " + text + b" ", np.uint8)
    for at in range(0, len(raw) - 2, BLOCK):
        a = raw[at : at + BLOCK + 2].astype(np.uint32)
        tri = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        yield REPEATS + ((tri * np.uint32(0x9E3779B1)) >> np.uint32(8)).astype(np.int64) % (buckets - REPEATS)
    for at in range(0, len(words), BLOCK):
        part = words[max(0, at - 1) : at + BLOCK]
        same = np.array([0, 0, *map(eq, part[1:], part)], np.int64)
        if len(same) > 2:
            yield same[:-2] * 4 + same[1:-1] * 2 + same[2:]


@dataclass
class Ratio:
    """Counts of all text and of good text by bucket."""

    raw: np.ndarray
    good: np.ndarray

    def __post_init__(self):
        self.n_raw, self.n_good = self.raw.sum(), self.good.sum()

    def of(self, text: bytes | None, is_good: bool) -> float:
        """Mean over the text's n-grams of the log of their probability in good text over that in all text; 0 without words.

        The text's own n-grams are taken out of the counts first, else rare ones would speak for a labelled text and
        against one without label. The mean, as a sum would add up a slight lean of a whole language over a long text.
        """
        own = np.zeros(len(self.raw), np.int64)
        for b in buckets_of(text, len(self.raw)):
            own += np.bincount(b, minlength=len(own))
        n = int(own.sum())
        if not n or not self.n_good:
            return 0.0
        at = np.flatnonzero(own)
        own = own[at]
        p = (self.good[at] - own * is_good + SMOOTHING) / (self.n_good - n * is_good + SMOOTHING * len(self.raw))
        q = (self.raw[at] - own + SMOOTHING) / (self.n_raw - n + SMOOTHING * len(self.raw))
        return float(own @ np.log(p / q)) / n


def counts(marked: DataFrame, buckets: int = BUCKETS) -> Ratio:
    """Counts over all of ``marked`` (``body`` and ``_label``). Each partition sends its non-zero buckets, and the driver gets one row a bucket."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for part in parts:
            for t, mark in zip(part["body"], part["_label"], strict=True):
                for b in buckets_of(t, buckets):
                    n = np.bincount(b, minlength=buckets)
                    raw += n
                    if mark == 1:
                        good += n
        some = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": some, "raw": raw[some], "good": good[some]})

    rows = marked.select("body", "_label").mapInPandas(count, "bucket int, raw bigint, good bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    return Ratio(raw, good)


def log_ratio(text: Column, label: Column, model: Ratio) -> Column:
    @F.pandas_udf("double")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, marks in parts:
            yield pd.Series([model.of(t, m == 1) for t, m in zip(texts, marks, strict=True)], dtype="float64")

    return of.asNondeterministic()(body(text), label)  # so that filters never run it twice


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a 64-bit hash of the document's id: the same in every run and partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11)
    return -F.log(-F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024, enough: int = 4096) -> float:
    """The k-th largest value, exactly: counts in ever narrower ranges until few different values are left."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if k <= 0 or low is None:
        return float("inf")
    if k >= df.count():
        return low
    above = 0  # values over ``high``
    while low < high:
        inside = df.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        rows = inside.groupBy(F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("bin")).collect()
        for r in rows:  # at most ``bins`` rows
            if above + r["n"] >= k:
                break
            above += r["n"]
        if len(rows) == 1 and r["low"] == low and r["high"] == high:
            break  # no narrower: neighbouring numbers
        low, high = r["low"], r["high"]
        if r["n"] <= enough:
            return sorted((x[0] for x in df.where((F.col(column) >= low) & (F.col(column) <= high)).select(column).collect()), reverse=True)[k - above - 1]
    return low


def labelled_cut(scored: DataFrame) -> float:
    """The least log ratio that parts labels 1 from 0 about as well as any does (sum of the shares on their right sides), on a fixed fine scale."""
    marked = scored.where("label is not null")
    step = 256
    at = F.floor(F.col("ratio") * step)
    rows = marked.groupBy(at.alias("bin")).agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("good"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # a few thousand bins at most
    good, bad = sum(r["good"] for r in rows), sum(r["n"] - r["good"] for r in rows)
    if not good or not bad:
        return float("-inf")
    values, g, b = [], 0, 0
    for r in rows:
        values.append(((good - g) / good + b / bad, r["bin"] / step))
        g, b = g + r["good"], b + r["n"] - r["good"]
    best = max(value for value, _ in values)
    return min(cut for value, cut in values if value >= best - LENIENCE)


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", k: int | None = None, sharpness: float = SHARPNESS, seed: int = SEED) -> tuple[DataFrame, str, float]:
    """``docs`` with ``log_ratio`` and ``key`` in one struct column, its name, and the least key that is sampled.

    The key is ``sharpness`` times the mean log ratio plus Gumbel noise; the ``k`` largest keys are a sample without
    replacement, weighted by the importance to that power. Without ``k`` it is the number of documents whose ratio lies over the cut that parts
    the labels best. Equal keys at the end are all taken, so repeated rows stay or go together. Null and empty texts
    have ratio 0. Without any good label all ratios are 0 and all documents stay. Null ids share one noise value. A
    document with several labels has the smallest.
    """
    (name,) = fresh(docs, "_importance")
    named = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").alias("label"))
    marked = labelled(docs.select(F.struct(*plain(docs)).alias("_row"), F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), named, "label")
    model = counts(marked.select(body("text").alias("body"), "_label"))
    rated = marked.withColumn("_ratio", log_ratio(F.col("text"), F.col("_label"), model)).withColumn("_key", F.col("_ratio") * sharpness + gumbel(F.col("doc_id"), seed))
    scored = rated.select(F.col("_ratio").alias("ratio"), F.col("_key").alias("key"), F.col("_label").alias("label"))
    scored = written(scored, "importance")
    if k is None:
        k = scored.where(F.col("ratio") >= labelled_cut(scored)).count()
    out = rated.select("_row.*", F.struct(F.col("_ratio").alias("log_ratio"), F.col("_key").alias("key")).alias(name))
    return out, name, kth_largest(scored, "key", k)


def kept(name: str, least: float) -> Column:
    return F.col(f"{name}.key") >= least


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out, name, least = resample(docs.select("doc_id", "text"), labels)
    return out.select("doc_id", f"{name}.log_ratio", f"{name}.key", kept(name, least).alias("kept"))
