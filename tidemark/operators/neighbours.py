"""Nearest neighbours among the most recent rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bayes import best_class
from tidemark.plans.spans import apply_spans_arrow
from tidemark.plans.stream import Stream

WINDOW = 1_000  # rows kept by a sliding-window model unless told otherwise
BATCH = 64
#: Up to so many neighbours are picked one by one, which is faster than a sort.
PICKS = 16


def _matrix(pdf: pd.DataFrame, features: list[str]) -> np.ndarray:
    if len(features) == 1 and pdf[features[0]].dtype == object:
        return np.stack(pdf[features[0]].to_numpy()).astype(float)
    return pdf[features].to_numpy(float)


def first_places(dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``k`` smallest numbers of each row in ascending order, the first place on ties. ``dist`` is used up; what
    is infinite is not distinguished."""
    k = min(k, dist.shape[1])
    if k > PICKS:
        place = np.argsort(dist, axis=1, kind="stable")[:, :k]
        return place, np.take_along_axis(dist, place, 1)
    row = np.arange(len(dist))
    place, value = np.zeros((len(dist), k), np.int64), np.zeros((len(dist), k))
    for i in range(k):
        place[:, i] = dist.argmin(axis=1)
        value[:, i] = dist[row, place[:, i]]
        dist[row, place[:, i]] = np.inf
    return place, value


def nearest(stream: Stream, features: list[str], k: int = 5, window: int = WINDOW, rows: DataFrame | None = None) -> DataFrame:
    """(step, y, neighbours): the k nearest of the ``window`` rows before, as (step, distance, y), nearest first.

    Exact search; equal distances prefer the more recent row. Work per row is bounded by the window.
    """
    return nearest_of(stream, features, k, {"neighbours": window}, rows)


def nearest_of(stream: Stream, features: list[str], k: int, windows: dict[str, int], rows: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same for several windows in one pass: a column of neighbours for each name, and the columns ``keep`` of ``rows``."""
    rows = stream.df if rows is None else rows
    target, reach = stream.target, max(windows.values())
    use = rows.select("step", *dict.fromkeys([*features, *keep]), F.col(target).alias("_y"))
    kinds = dict(use.dtypes)

    def search(table: pa.Table, first: int) -> pa.Table:
        step, y = table["step"].to_numpy(), table["_y"].combine_chunks()
        x = _matrix(table.select(features).to_pandas(), features)
        begin = int(np.searchsorted(step, first))
        found = {name: [] for name in windows}
        for lo in range(begin, len(step), BATCH):
            hi = min(lo + BATCH, len(step))
            # candidates newest first, so that the first of equal distances is the most recent row
            cand = np.arange(hi - 1, max(lo - reach, 0) - 1, -1)
            dist = np.zeros((hi - lo, len(cand)))
            for j in range(x.shape[1]):
                diff = x[lo:hi, j][:, None] - x[cand, j][None, :]
                dist += diff * diff
            age = np.arange(lo, hi)[:, None] - cand[None, :]
            dist[(age < 1) | np.isnan(dist)] = np.inf
            for name, window in windows.items():
                wide = hi - lo + window
                place, far = first_places(np.where(age[:, :wide] > window, np.inf, dist[:, :wide]), k)
                on = np.isfinite(far)
                found[name].append((on.sum(1), cand[place[on]], far[on]))
        columns = {"step": table["step"].slice(begin), "y": y.slice(begin)}
        for name, parts in found.items():
            size, at, far = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
            near = pa.StructArray.from_arrays([pa.array(step[at]), pa.array(np.sqrt(far)), y.take(pa.array(at))], ["step", "distance", "y"])
            columns[name] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), near)
        return pa.table(columns | {c: table[c].slice(begin) for c in keep})

    near = f"array<struct<step:long,distance:double,y:{kinds['_y']}>>"
    schema = ", ".join([f"step long, y {kinds['_y']}", *(f"`{n}` {near}" for n in windows), *(f"`{c}` {kinds[c]}" for c in keep)])
    return apply_spans_arrow(use, stream.n, reach, search, schema)


def neighbour_pairs(stream: Stream, features: list[str], k: int, window: int) -> DataFrame:
    """One row per (row, neighbour) with the neighbour's rank."""
    found = nearest(stream, features, k, window)
    return found.select("step", F.posexplode("neighbours").alias("p", "n")).select(
        "step", (F.col("p") + 1).alias("position"), F.col("n.step").alias("neighbour"), "n.distance", "n.y"
    )


def _votes(classes: list, weight, near: str) -> list[Column]:
    def vote(c):
        return F.aggregate(near, F.lit(0.0), lambda acc, n: acc + F.when(n["y"] == c, weight(n)).otherwise(0.0))

    return [vote(c) for c in classes]


def knn_class(found: DataFrame, classes: list, weighted: bool = False, name: str = "knn", near: str = "neighbours") -> DataFrame:
    """Vote of the neighbours (by inverse distance if ``weighted``); NULL without neighbours."""
    votes = _votes(classes, (lambda n: 1.0 / (n["distance"] + 1e-9)) if weighted else (lambda n: F.lit(1.0)), near)
    # a column of its own, so that a vote is counted once and not wherever it is compared
    found = found.withColumn("_votes", F.array(*votes))
    pick = F.when(F.size(near) > 0, best_class([F.get("_votes", F.lit(i)) for i in range(len(classes))], classes))
    return found.withColumn(name, pick).drop("_votes")


def knn_mean(found: DataFrame, name: str = "knn") -> DataFrame:
    """Mean target of the neighbours; 0.0 without neighbours."""
    total = F.aggregate("neighbours", F.lit(0.0), lambda acc, n: acc + n["y"])
    return found.withColumn(name, F.when(F.size("neighbours") > 0, total / F.size("neighbours")).otherwise(0.0))
