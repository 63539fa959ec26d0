"""Isolation-style scorers: trees built on a sample of the block before, scored by column expressions.

Which rows a tree sees depends on a hash only, and a block is scored with trees of the block before, so all
blocks are built and scored at once. A tree is built from a sample of the block; its size is an argument.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import uniform, walk
from tidemark.plans.blocks import Blocks
from tidemark.plans.stream import parallelism

SAMPLE = 256
DEPTH = 8
TREE = "feature array<int>, cut array<double>, value array<double>"


def _average_path(n: float) -> float:
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n if n > 2 else float(n == 2)


def build_tree(x: np.ndarray, kind: str, rng: np.random.Generator, depth: int = DEPTH) -> tuple[list, list, list]:
    """One random tree in heap order with a value per leaf.

    ``path``: uniform feature and cut, value = depth + expected rest (Liu et al. 2008). ``histogram``: feature
    by kurtosis, value = surprise of the leaf (Putina et al. 2020). ``displacement``: feature by range, value
    = largest sibling-to-self ratio on the path (Guha et al. 2016).
    """
    nodes = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
    todo = [(0, np.arange(len(x)), 0, 0.0)]
    while todo:
        node, rows, level, shift = todo.pop()
        part = x[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
        open_ = np.flatnonzero(high > low)
        if level == depth or len(rows) < 2 or not len(open_):
            if kind == "path":
                value[node] = level + _average_path(len(rows))
            elif kind == "histogram":
                value[node] = math.log(max(len(x), 1) / max(len(rows), 0.5))
            else:
                value[node] = shift
            continue
        if kind == "path":
            weight = np.ones(len(open_))
        elif kind == "histogram":
            z = (part[:, open_] - part[:, open_].mean(axis=0)) / part[:, open_].std(axis=0)
            weight = np.log((z**4).mean(axis=0) + 1.0)
        else:
            weight = (high - low)[open_]
        f = int(rng.choice(open_, p=weight / weight.sum()))
        c = float(rng.uniform(low[f], high[f]))
        feature[node], cut[node] = f, c
        left = part[:, f] <= c
        sides = (rows[left], rows[~left])
        for j, mine in enumerate(sides):
            other = sides[1 - j]
            todo.append((2 * node + 1 + j, mine, level + 1, max(shift, len(other) / (len(mine) + 1.0))))
    return feature.tolist(), cut.tolist(), value.tolist()


def tree_scores(blocks: Blocks, features: list[str], kind: str = "path", n_trees: int = 10, seed: int = 42, name: str = "score", sample: int = SAMPLE) -> DataFrame:
    """Add the score of every row; 0.0 in the first block, which has no trees.

    A tree sees the ``sample`` rows of its block with the smallest hashes (all rows of a smaller block). Rows are first
    thinned to a share that holds so many but for a chance below 1e-20.
    """
    rows = blocks.stream.df.select("step", *[F.col(f).cast("double").alias(f) for f in features])
    rows = rows.withColumn("block", blocks.number())
    share = min(1.0, (sample + 10 * math.sqrt(sample) + 50) / blocks.size)
    draw = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: F.struct(t.alias("tree"), uniform(F.lit(seed), t, F.col("step")).alias("u")))
    picked = rows.withColumn("p", F.explode(F.filter(draw, lambda d: d["u"] <= share))).select("block", "p.tree", "p.u", "step", *features)
    rank = F.row_number().over(Window.partitionBy("block", "tree").orderBy("u", F.xxhash64(F.lit(seed), "tree", "step")))
    picked = picked.withColumn("_r", rank).filter(F.col("_r") <= sample)

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        f, c, v = build_tree(pdf[features].to_numpy(float), kind, np.random.default_rng([seed, int(key[0]), int(key[1])]))
        return pd.DataFrame({"block": [key[0]], "tree": [key[1]], "feature": [f], "cut": [c], "value": [v]})

    trees = picked.repartition(parallelism(rows), "block", "tree").groupBy("block", "tree").applyInPandas(build, f"block int, tree int, {TREE}")
    state = trees.groupBy((F.col("block") + 1).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("tree", "feature", "cut", "value"))).alias("trees")
    )
    # one row per block, each with n_trees small trees
    out = rows.join(F.broadcast(state), "block", "left").withColumn("_x", F.array(*features))
    reached = F.transform("trees", lambda t: F.get(t["value"], walk(F.col("_x"), t["feature"], t["cut"], DEPTH)))
    mean = F.aggregate(reached, F.lit(0.0), lambda a, v: a + v) / n_trees
    if kind == "path":
        mean = F.pow(F.lit(2.0), -mean / _average_path(min(sample, blocks.size)))
    return out.withColumn(name, F.coalesce(mean, F.lit(0.0))).select("step", name)
