"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few random directions, shifted, and ordered along a Hilbert curve, once for each of several
curves. Spark range-partitions every ordering and numbers its rows. A query is compared with all rows of a window
around its own place on each curve; the windows' best are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ranked
from tidemark.session import written

CURVES = 32
DIMENSIONS = 12
BITS = 4
#: Rows on either side of a query's place: this share of all rows, and at least so many.
WINDOW_SHARE = 0.01
LEAST_WINDOW = 64
#: Most rows of one curve that are compared in one task at a time.
CHUNK = 2048


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of cells (rows of ``d`` numbers below 2^bits) along the Hilbert curve, by the transpose form of the index."""
    x = cells.T.astype(np.uint64).copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = np.uint64((1 << b) - 1)
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(high, low, swap).astype(np.uint64)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[d - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0)).astype(np.uint64)
    x ^= turn
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            place = (place << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return place.astype(np.int64)


@dataclass(frozen=True)
class Curves:
    """Random directions and shifts of all curves, from a seed; places need the projections' means and deviations."""

    dimension: int
    curves: int
    directions: int
    bits: int
    seed: int

    def basis(self) -> np.ndarray:
        """One column for each direction of each curve; orthonormal within a curve."""
        rng = np.random.default_rng(self.seed)
        d = min(self.directions, self.dimension)
        return np.concatenate([np.linalg.qr(rng.normal(size=(self.dimension, d)))[0] for _ in range(self.curves)], axis=1)

    def shifts(self) -> np.ndarray:
        return np.random.default_rng(self.seed + 1).uniform(0, 1, (self.curves, min(self.directions, self.dimension)))

    def places(self, projected: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> Iterator[np.ndarray]:
        """Places on each curve: three deviations to either side fill half the cube, which the shift moves within it."""
        d = min(self.directions, self.dimension)
        unit = np.clip((projected - mean) / (6 * np.where(deviation > 0, deviation, 1)) + 0.5, 0, 1)
        for c, shift in enumerate(self.shifts()):
            cells = ((unit[:, c * d : (c + 1) * d] + shift) / 2 * (1 << self.bits)).astype(np.int64)
            yield hilbert(np.minimum(cells, (1 << self.bits) - 1), self.bits)


def _matrix(raw: pd.Series, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distinct_vectors(vectors: DataFrame, vec_id: str, vector: str, keep: int, kind: str) -> DataFrame:
    """``u`` (a number), ``raw`` (a vector's bytes) and ``ids`` (its ``keep`` smallest ids) for each different vector that takes part."""

    def reduce(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, list[int]] = {}

        def frame():
            out = pd.DataFrame({"raw": pd.Series(list(seen), dtype=object), "ids": pd.Series(list(seen.values()), dtype=object)})
            seen.clear()
            return out

        for part in parts:
            for i, v in zip(part["id"], part["v"], strict=True):
                if v is None or pd.isna(i):
                    continue
                v = np.asarray(v, kind)
                if not len(v) or not np.isfinite(v).all() or not v.any():
                    continue
                ids = seen.setdefault((v + 0).tobytes(), [])  # + 0: one zero
                if int(i) not in ids:
                    ids.append(int(i))
                    if len(ids) > keep:
                        ids.remove(max(ids))
            if len(seen) > 100_000:
                yield frame()
        yield frame()

    narrow = vectors.select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").alias("v"))
    parts = narrow.mapInPandas(reduce, "raw binary, ids array<bigint>")
    # a few ids from each partition
    one = parts.groupBy("raw").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids"))
    every = written(one.withColumn("u", F.monotonically_increasing_id()), "vectors")
    sizes = every.groupBy(F.octet_length("raw").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return every.where(F.octet_length("raw") == (sizes["n"] if sizes else 0))


def _moments(distinct: DataFrame, c: Curves, kind: str) -> tuple[np.ndarray, np.ndarray]:
    def sums(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis = c.basis()
        n, s, q = 0, np.zeros(basis.shape[1]), np.zeros(basis.shape[1])
        for part in parts:
            y = _unit(_matrix(part["raw"], kind)) @ basis
            n, s, q = n + len(y), s + y.sum(0), q + (y * y).sum(0)
        yield pd.DataFrame({"i": np.arange(len(s)), "n": n, "s": s, "q": q})

    rows = distinct.select("raw").mapInPandas(sums, "i int, n bigint, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").toPandas()
    mean = rows["s"].to_numpy() / rows["n"].to_numpy()
    return mean, np.sqrt(np.maximum(rows["q"].to_numpy() / rows["n"].to_numpy() - mean**2, 0))


def neighbours(
    vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, curves: int = CURVES,
    directions: int = DIMENSIONS, bits: int = BITS, share: float = WINDOW_SHARE, least: int = LEAST_WINDOW, seed: int = 5,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` (cosine in double precision) of the ``k`` nearest found of each query.

    ``queries`` are rows of ``vectors``; candidates are all others. Equal vectors are searched once and written out with
    their smallest ids, so copies neither crowd a window nor hide a tie. Vectors that are null, empty, zero, hold null or
    non-finite components, or have another length than most take no part, nor do null ids; rows that repeat id and vector
    count once. The window is a share of all rows, as in data without clusters the neighbours of a point lie scattered
    over such a share of each curve; in chunks of at most CHUNK rows, so no task holds a whole window.
    """
    kind = "<f4" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "<f8"
    distinct = distinct_vectors(vectors, vec_id, vector, k + 1, kind)
    total, length = distinct.agg(F.count(F.lit(1)), F.max(F.octet_length("raw"))).first()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not total:
        return vectors.sparkSession.createDataFrame([], empty)
    c = Curves(length // np.dtype(kind).itemsize, curves, directions, bits, seed)
    mean, deviation = _moments(distinct, c, kind)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis = c.basis()
        for part in parts:
            y = _unit(_matrix(part["raw"], kind)) @ basis
            for i, p in enumerate(c.places(y, mean, deviation)):
                yield pd.DataFrame({"curve": i, "place": p, "u": part["u"].to_numpy()})

    placed = distinct.select("u", "raw").mapInPandas(place, "curve int, place bigint, u bigint")
    window = max(least, int(np.ceil(share * total)))
    chunk = min(window, CHUNK)
    order = written(ranked(placed, ["place", "u"], by=["curve"], label="curve").select("curve", "u", F.col("_rank").alias("rank")), "curves")

    asked = written(queries.select(F.col(f"`{vec_id}`").cast("bigint").alias("query_id"), F.col(f"`{vector}`").alias("v")).distinct(), "queries")
    keyed = _keys(asked, kind).join(distinct.select("u", "raw"), "raw").select("query_id", "u")
    keyed = written(keyed, "query-keys")
    wanted = keyed.select("u").distinct()

    spots = order.groupBy("u").agg(F.collect_list(F.struct("curve", F.floor(F.col("rank") / chunk).alias("chunk"))).alias("spots"))  # one a curve
    data = distinct.select("u", "raw", F.element_at("ids", 1).alias("least")).join(spots, "u").select("u", "raw", "least", F.explode("spots").alias("s")).select("u", "raw", "least", "s.curve", "s.chunk")
    reach = F.sequence(F.greatest(F.lit(0), F.floor((F.col("rank") - window) / chunk)), F.floor(F.least(F.lit(total - 1), F.col("rank") + window) / chunk))
    visits = order.join(wanted, "u", "left_semi").groupBy("u").agg(F.collect_list(F.struct("curve", reach.alias("chunks"))).alias("to"))
    visits = distinct.select("u", "raw").join(visits, "u").select("u", "raw", F.explode("to").alias("t")).select("u", "raw", "t.curve", F.explode("t.chunks").alias("chunk")).toDF("q", "asked", "at_curve", "at_chunk")

    def compare(asking: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"q": [], "u": [], "least": [], "score": []}
        if len(asking) and len(rows):
            x, y = _matrix(rows["raw"], kind), _matrix(asking["asked"], kind)
            norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
            u, low = rows["u"].to_numpy(), rows["least"].to_numpy()
            for at in range(0, len(y), 512):
                s = (y[at : at + 512] @ x.T) / (norm_y[at : at + 512, None] * norm_x)
                for q, row in zip(asking["q"].to_numpy()[at : at + 512], s, strict=True):
                    # the query's own vector is among them if its place is in this chunk; all that tie with the last stay in view
                    bar = np.partition(row, -(k + 1))[-(k + 1)] if len(row) > k + 1 else -np.inf
                    near = np.flatnonzero(row >= bar)
                    near = near[np.lexsort((low[near], -row[near]))][: k + 1]
                    out["q"] += [q] * len(near)
                    out["u"] += u[near].tolist()
                    out["least"] += low[near].tolist()
                    out["score"] += row[near].tolist()
        return pd.DataFrame(out)

    found = visits.groupBy("at_curve", "at_chunk").cogroup(data.groupBy("curve", "chunk")).applyInPandas(compare, "q bigint, u bigint, least bigint, score double")
    # each curve gives a query its k + 1 best of a few chunks
    one = found.groupBy("q", "u").agg(F.max("score").alias("score"), F.first("least").alias("least"))
    best = one.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "least", "u"))), 1, k + 1).alias("b"))
    best = written(best.select("q", F.explode("b").alias("b")).select("q", "b.far", "b.u"), "nearest")
    ids = best.join(distinct.select("u", "ids"), "u").select("q", "far", F.explode("ids").alias("id"))
    lists = ids.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("b"))
    mine = keyed.join(lists, keyed["u"] == lists["q"]).select("query_id", F.slice(F.filter("b", lambda x: x["id"] != F.col("query_id")), 1, k).alias("b"))
    return mine.select("query_id", F.posexplode("b").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def _keys(asked: DataFrame, kind: str) -> DataFrame:
    """Queries by their vectors' bytes, as distinct vectors are."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"query_id": part["query_id"], "raw": [None if v is None else (np.asarray(v, kind) + 0).tobytes() for v in part["v"]]})

    return asked.where("query_id is not null").mapInPandas(run, "query_id bigint, raw binary")


def digest(vectors: DataFrame, every: int = 50) -> DataFrame:
    return neighbours(vectors, vectors.where(F.col("vec_id") % every == 0))


def recall(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5) -> float:
    """Share of the true ``k`` nearest that were found, by comparing ``queries`` (a bounded set) with all rows in turn."""
    rows = queries.select("vec_id", "embedding").collect()
    ids, y = np.array([r[0] for r in rows]), _unit(np.array([r[1] for r in rows], np.float64))

    def nearest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = part["vec_id"].to_numpy()
            s = y @ _unit(np.stack(part["embedding"].to_list()).astype(np.float64)).T
            s[ids[:, None] == x] = -2
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            yield pd.DataFrame({"q": np.repeat(ids, top.shape[1]), "v": x[top].ravel(), "s": np.take_along_axis(s, top, 1).ravel()})

    per = vectors.select("vec_id", "embedding").mapInPandas(nearest, "q bigint, v bigint, s double").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("far"), "v"))), 1, k).alias("b"))
    true = per.select("q", F.explode("b.v").alias("v"))
    return true.join(found, (F.col("q") == F.col("query_id")) & (F.col("v") == F.col("vec_id")), "left_semi").count() / max(1, true.count())
