"""Adaptive model rules (Almeida, Ferreira and Gama 2013) with block updates.

A rule is a box of feature values. A row belongs to the first rule that covers it, or to the default rule. A job per block counts
(rule, feature, bin) histograms over edges that follow all rows so far; rules grow by the Hoeffding test and go on drift. The rows of
a block are scored with the rules before it and written, so one state is alive at a time.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import interval_of
from tidemark.operators.drift import BlockAdwin
from tidemark.operators.edges import BINS, Edges, carried, value
from tidemark.plans.blocks import Blocks
from tidemark.session import scratch_path


class Rule:
    """A box (above ``lo``, up to ``hi``) and what its rows showed."""

    def __init__(self, n: int, value: float = 0.0) -> None:
        self.lo, self.hi, self.value = [-math.inf] * n, [math.inf] * n, value
        self.hist, self.adwin = np.zeros((n, BINS, 3)), BlockAdwin()


def _deviation(c: np.ndarray) -> np.ndarray:
    n = np.maximum(c[..., 0], 1e-12)
    return np.sqrt(np.maximum(c[..., 2] / n - (c[..., 1] / n) ** 2, 0.0))


def _best_cut(h: np.ndarray, delta: float, tie: float):
    """(feature, cut, keep_left) if a literal passes the Hoeffding test, else None."""
    found = []
    total = h[0].sum(axis=0)
    for f in range(len(h)):
        left = h[f].cumsum(axis=0)[:-1]
        right = total - left
        ok = (left[:, 0] > 1e-9) & (right[:, 0] > 1e-9)
        if ok.any():
            gain = _deviation(total) - (left[:, 0] * _deviation(left) + right[:, 0] * _deviation(right)) / max(total[0], 1e-12)
            cut = int(np.argmax(np.where(ok, gain, -np.inf)))
            found.append((float(gain[cut]), f, cut, bool(_deviation(left[cut]) <= _deviation(right[cut]))))
    found.sort(key=lambda g: -g[0])
    if not found or found[0][0] <= 0:
        return None
    bound = math.sqrt(math.log(1 / delta) / (2 * max(total[0], 1.0)))
    second = max(found[1][0], 0.0) if len(found) > 1 else 0.0
    return found[0][1:] if 1 - second / found[0][0] > bound or bound < tie else None


def covering(rules: list[Rule], features: list[str]) -> Column:
    """Number of the first rule that covers a row; the last one covers all."""
    out = F.lit(len(rules) - 1)
    for i, r in reversed(list(enumerate(rules[:-1]))):
        inside = F.lit(True)
        for f, lo, hi in zip(features, r.lo, r.hi, strict=True):
            if lo > -math.inf:
                inside = inside & (value(f) > lo)
            if hi < math.inf:
                inside = inside & (value(f) <= hi)
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def model_rules(
    blocks: Blocks, features: list[str], target: Column, delta: float = 1e-7, tie: float = 0.05, name: str = "model_rules"
) -> DataFrame:
    """Add the prediction (mean target of the covering rule), as a table. Rows without a target are scored and not learned."""
    rows, n = blocks.stream.df, len(features)
    rules, edges = [Rule(n)], Edges(features)  # the last one is the default rule
    path, out = scratch_path(rows.sparkSession, "rules"), None
    with ThreadPoolExecutor(1) as pool:
        for b in range(1, blocks.used + 1):
            values = F.array(*[F.lit(float(r.value)) for r in rules])
            mean = F.get(values, covering(rules, features)) if b > 1 else F.lit(0.0)
            here = blocks.rows(b, rows)
            out = here.withColumn(name, mean)
            writing = pool.submit(out.write.mode("append").parquet, path)
            if b < blocks.used:
                _learn(rules, edges, here.where(target.isNotNull()), features, target.cast("double"), delta, tie)
            writing.result()
    return rows.sparkSession.read.schema(out.schema).parquet(path) if out is not None else rows.withColumn(name, F.lit(0.0))


def _learn(rules: list[Rule], edges: Edges, rows: DataFrame, features: list[str], y: Column, delta: float, tie: float) -> None:
    """Fold a block into the rules."""
    n = len(features)
    if (moved := edges.add(rows)) is not None:
        for r in rules:
            r.hist = carried(r.hist, moved)
    bins = F.array(*[interval_of(value(f), e.tolist()) for f, e in zip(features, edges.of, strict=True)])
    values = F.array(*[F.lit(float(r.value)) for r in rules])
    here = rows.select(covering(rules, features).alias("rule"), y.alias("_y"), bins.alias("_bins"))
    here = here.withColumn("_e", F.pow(F.col("_y") - F.get(values, F.col("rule")), F.lit(2)))
    table = (
        here.select("rule", "_y", "_e", F.posexplode_outer("_bins").alias("f", "bin"))
        .groupBy("rule", "f", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q"), F.sum("_e").alias("e"), F.sum(F.col("_e") * F.col("_e")).alias("e2"), F.max("_e").alias("top"))
        .toPandas()
    )
    keep, new = [], []
    for i, r in enumerate(rules):
        part = table[table["rule"] == i]
        h = np.zeros((n, BINS, 3))
        for j, c in enumerate(("n", "s", "q")):
            np.add.at(h[:, :, j], (part["f"].to_numpy(int), part["bin"].to_numpy(int)), part[c].to_numpy(float))
        own = part[part["f"] == 0]
        default = i == len(rules) - 1
        if len(own) and r.adwin.add(own["n"].sum(), own["e"].sum(), own["e2"].sum(), own["top"].max()) and not default:
            continue  # drifted: the rule goes
        r.hist = r.hist + h
        seen = r.hist[0].sum(axis=0)
        r.value = float(seen[1] / seen[0]) if seen[0] else r.value
        cut = _best_cut(r.hist, delta, tie)
        if cut and cut[1] < len(edges.of[cut[0]]):
            f, c, left = cut
            grown = Rule(n, r.value) if default else r
            grown.lo, grown.hi = list(r.lo), list(r.hi)
            if left:
                grown.hi[f] = min(grown.hi[f], edges.cut(f, c))
            else:
                grown.lo[f] = max(grown.lo[f], edges.cut(f, c))
            side = r.hist[f][: c + 1].sum(axis=0) if left else r.hist[f][c + 1 :].sum(axis=0)
            grown.value = float(side[1] / side[0])
            if default:
                new.append(grown)
            r.hist = np.zeros_like(r.hist)
        keep.append(r)
    rules[:] = [*keep[:-1], *new, keep[-1]]
