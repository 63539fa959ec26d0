"""Language identification as a mixture: each document's language proportions by expectation-maximisation over n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, crc_mod

BUCKETS = 1 << 15
SMOOTHING = 0.5
#: Most languages a model may have; a labels column with more values is taken for a mistake.
LANGUAGES = 500
ROUNDS = 12
#: Each further language must raise the log likelihood by this much for each log of the number of n-grams.
PENALTY = 2.0
#: Bytes taken at a time.
BLOCK = 1 << 20
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def buckets_of(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams and 4-grams of a text in lower case, block by block."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for at in range(0, len(raw) - 2, BLOCK):
        a = raw[at : at + BLOCK + 3].astype(np.uint32)
        tri = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]
        four = (tri[:-1] << np.uint32(8)) | a[3:]
        yield np.concatenate([tri[:BLOCK] * np.uint32(0x9E3779B1) >> np.uint32(9), four * np.uint32(0x85EBCA77) >> np.uint32(9)]).astype(np.int64) % buckets


def ngrams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    n = np.zeros(buckets, np.int64)
    for b in buckets_of(text, buckets):
        n += np.bincount(b, minlength=buckets)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Mixture:
    """Probability of each bucket in each language."""

    languages: list[str]
    log_p: np.ndarray

    def _em(self, p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
        total = n.sum()
        for _ in range(ROUNDS):
            mixed = p @ share
            new = share * (p.T @ (n / mixed)) / total
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(p @ share + 1e-300))

    def proportions(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Shares of all languages (0 for those not selected), for n-gram counts ``n`` of buckets ``at``.

        Starting from all languages, the smallest share is left out as long as that lowers the log likelihood by no more
        than the penalty for one language.
        """
        logs = self.log_p[at]
        p = np.exp(logs - logs.max(1, keepdims=True))  # scaled by n-gram, which changes no share
        price = PENALTY * np.log(max(2, n.sum()))
        chosen = np.arange(len(self.languages))
        share, fit = self._em(p, n, np.full(len(chosen), 1 / len(chosen)))
        while len(chosen) > 1:
            # a language whose share is nearly nil is cheap to leave out; several such go at once
            nil = share < 1e-3
            drop = nil if nil.any() else np.arange(len(share)) == share.argmin()
            rest = share[~drop] / share[~drop].sum()
            less, worse = self._em(p[:, chosen[~drop]], n, rest)
            if fit - worse > price * drop.sum():
                break
            chosen, share, fit = chosen[~drop], less, worse
        out = np.zeros(len(self.languages))
        out[chosen] = share / share.sum()
        return out


def fit(texts: DataFrame, buckets: int = BUCKETS) -> Mixture:
    """A model from all rows of ``texts`` (``body`` and ``lang``, null ones left out). Partitions send counts by language and bucket."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for part in parts:
            for t, lang in zip(part["body"], part["lang"], strict=True):
                if t:
                    n = total.setdefault(lang, np.zeros(buckets, np.int64))
                    for b in buckets_of(t.decode("utf-8", "replace"), buckets):
                        n += np.bincount(b, minlength=buckets)
            if len(total) > LANGUAGES:
                raise ValueError(f"more than {LANGUAGES} languages")
        for lang, n in total.items():
            some = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": n[some]})

    languages = sorted(r["lang"] for r in texts.where("lang is not null").select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    rows = texts.where("lang is not null").select("body", "lang").mapInPandas(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # a number for each language and bucket
    counts = np.zeros((buckets, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    if rows.num_rows:
        counts[rows["bucket"].to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    counts += SMOOTHING
    return Mixture(languages, np.log(counts / counts.sum(0)).astype(np.float32))


def languages(text: Column, model: Mixture) -> Column:
    """Languages with their shares, largest first; empty for a text that is null, has no letter, or without a learned language."""

    @F.pandas_udf("names array<string>, shares array<double>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for raw in texts:
                t = raw.decode("utf-8", "replace") if raw else ""
                if not model.languages or not has_letter(t):
                    rows.append(([], []))
                    continue
                share = model.proportions(*ngrams(t, len(model.log_p)))
                order = [i for i in np.argsort(-share, kind="stable") if share[i] > 0]
                rows.append(([model.languages[i] for i in order], share[order].tolist()))
            yield pd.DataFrame(rows, columns=["names", "shares"])

    return of.asNondeterministic()(body(text))


def digest(docs: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """The language with the largest share and that share; ``und`` and 0 where there is none. Null ids are learned from."""
    out = F.coalesce(crc_mod("doc_id", parts) == held, F.lit(False))
    model = fit(docs.where(~out).select(body("text").alias("body"), "lang"))
    found = docs.select("doc_id", out.alias("held_out"), languages(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", F.coalesce(F.get("found.names", F.lit(0)), F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce(F.get("found.shares", F.lit(0)), F.lit(0.0)).alias("score"))
