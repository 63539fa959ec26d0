"""Anomaly scorers and their evaluation.

A scorer looks at a chosen value column (or features) of the rows before; the label is a separate column and
only used for the metrics.
"""

from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import two_sided
from tidemark.operators.metrics import classification_checkpoints
from tidemark.operators.linear import normal_equations
from tidemark.plans.blocks import Blocks
from tidemark.plans.prefix import lagged, moments, scan
from tidemark.plans.spans import apply_spans
from tidemark.plans.stream import Stream


def _spread(c: str):
    """Sample standard deviation from the population variance of the rows before."""
    n = F.col(f"{c}_n")
    return F.when(n > 1, F.sqrt(F.col(f"{c}_var") * n / (n - 1)))


def gaussian_scorer(stream: Stream, value: str, grace: int = 100, name: str = "gaussian", rows: DataFrame | None = None) -> DataFrame:
    """``abs(2 * cdf - 1)`` of the value under the normal law of the rows before; 0.0 in the first ``grace`` rows."""
    out = moments(stream, [value], rows)
    z = (F.col(value) - F.col(f"{value}_mean")) / _spread(value)
    score = F.when((F.col(f"{value}_n") >= grace) & (_spread(value) > 0), two_sided(z)).otherwise(0.0)
    return out.withColumn(name, score).drop(*[f"{value}_{k}" for k in ("n", "mean", "var")])


def absolute_deviation(stream: Stream, value: str, name: str = "deviation", rows: DataFrame | None = None) -> DataFrame:
    """Distance from the mean of the rows before in standard deviations; 0.0 before the second row."""
    out = moments(stream, [value], rows)
    score = F.abs(F.col(value) - F.col(f"{value}_mean")) / (_spread(value) + 1e-10)
    return out.withColumn(name, F.coalesce(score, F.lit(0.0))).drop(*[f"{value}_{k}" for k in ("n", "mean", "var")])


def predictive_scorer(stream: Stream, rows: DataFrame, pred: str, n_std: float = 3.0, name: str = "predictive") -> DataFrame:
    """Prediction error against ``mean + n_std * deviation`` of the earlier errors, at most 1.0.

    A row without a prediction or without a target scores 0.0 and its error does not count.
    """
    rows = rows.withColumn("_err", F.abs(F.col(stream.target) - F.col(pred)))
    sums = {"_en": F.col("_err").isNotNull().cast("double"), "_e1": F.col("_err"), "_e2": F.col("_err") * F.col("_err")}
    out = scan(stream, sums, rows=rows)
    seen = F.nullif(F.col("_en"), F.lit(0.0))
    mean = F.col("_e1") / seen
    limit = mean + n_std * F.sqrt(F.greatest(F.lit(0.0), F.col("_e2") / seen - mean * mean))
    score = F.coalesce(F.least(F.lit(1.0), F.col("_err") / F.nullif(limit, F.lit(0.0))), F.lit(0.0))
    score = F.when(limit.isNull() | F.col("_err").isNull(), 0.0).otherwise(score)
    return out.withColumn(name, score).drop("_err", *sums)


def forecasts(blocks: Blocks, value: str, order: int = 2, horizon: int = 1, name: str = "forecast") -> DataFrame:
    """Forecast of ``value`` made ``horizon`` rows before: least squares over the ``order`` values known then, fitted on the blocks before.

    NULL in the first block and where one of these values is missing.
    """
    lags = list(range(horizon, horizon + order))
    known = [f"{value}_lag{h}" for h in lags]
    rows = lagged(blocks.stream, value, lags)
    out = normal_equations(Blocks(replace(blocks.stream, df=rows), blocks.count), known, value, name=name)
    ready = F.col("step") > blocks.size
    for c in known:
        ready = ready & F.col(c).isNotNull()
    return out.withColumn(name, F.when(ready, F.col(name))).drop(*known)


def forecast_scorer(blocks: Blocks, value: str, order: int = 2, horizon: int = 1, n_std: float = 3.0, name: str = "predictive") -> DataFrame:
    """``predictive_scorer`` over the errors of ``forecasts``."""
    rows = forecasts(blocks, value, order, horizon)
    return predictive_scorer(replace(blocks.stream, target=value), rows, "forecast", n_std, name)


def half_space_trees(n_trees: int, height: int, n_features: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Random half-space trees over [0, 1] ranges in heap order: split feature and cut (the middle of the range)."""
    rng = random.Random(seed)
    inner = 2**height - 1
    feature, cut = np.zeros((n_trees, inner), int), np.zeros((n_trees, inner))
    for t in range(n_trees):
        ranges = {0: [(0.0, 1.0)] * n_features}
        for node in range(inner):
            box = ranges.pop(node)
            f = rng.randrange(n_features)
            lo, hi = box[f]
            mid = (lo + hi) / 2
            feature[t, node], cut[t, node] = f, mid
            for child, side in ((2 * node + 1, (lo, mid)), (2 * node + 2, (mid, hi))):
                ranges[child] = box[:f] + [side] + box[f + 1 :]
    return feature, cut


def half_space_scores(
    stream: Stream, features: dict[str, tuple[float, float]], n_trees: int = 10, height: int = 8, window: int = 250, seed: int = 42
) -> DataFrame:
    """(step, score): masses of the window before decide (Tan, Ting and Liu 2011).

    ``features`` gives each feature its range. The trees do not depend on the data; every window of rows is
    scored with the node masses of the window before, so all windows are independent of each other.
    """
    feature, cut = half_space_trees(n_trees, height, len(features), seed)
    limit, top = 0.1 * window, n_trees * window * (2.0 ** (height + 1) - 1)
    scaled = [((F.col(c) - lo) / (hi - lo)).cast("double").alias(f"x{i}") for i, (c, (lo, hi)) in enumerate(features.items())]
    names = [f"x{i}" for i in range(len(features))]

    def score(pdf: pd.DataFrame, first: int) -> pd.DataFrame:
        step, x = pdf["step"].to_numpy(), pdf[names].to_numpy(float)
        block = (step - 1) // window
        block -= block[0]
        total = np.zeros(len(step))
        rows = np.arange(len(step))
        for t in range(n_trees):
            path = np.zeros((len(step), height + 1), int)
            for level in range(height):
                node = path[:, level]
                right = x[rows, feature[t, node]] >= cut[t, node]
                path[:, level + 1] = 2 * node + 1 + right
            mass = np.zeros((block[-1] + 2, 2 ** (height + 1) - 1))
            for level in range(height + 1):
                np.add.at(mass, (block + 1, path[:, level]), 1.0)  # seen one window later
            open_ = np.ones(len(step), bool)
            for level in range(height + 1):
                m = mass[block, path[:, level]]
                total += np.where(open_, m * 2.0**level, 0.0)
                open_ &= m >= limit
        mine = step >= first
        return pd.DataFrame({"step": step[mine], "score": (1.0 - total / top)[mine]})

    size = window * max(1, math.ceil(4096 / window))
    return apply_spans(stream.df.select("step", *scaled), stream.n, window, score, "step long, score double", size)


def evaluate(scores: DataFrame, n: int, score: str, label: str, threshold: float = 0.5, rule: str = "floor") -> DataFrame:
    """Accuracy, precision, recall and F1 at checkpoints for ``score > threshold``; a missing score counts as 0.0."""
    pred = (F.coalesce(F.col(score), F.lit(0.0)) > threshold).cast("int")
    rows = scores.select("step", F.col(label).cast("int").alias("y"), F.lit(score).alias("model"), pred.alias("pred"))
    return classification_checkpoints(rows, n, rule, positive=1)
