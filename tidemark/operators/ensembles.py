"""Ensembles and mixed models built from the parts: shrubs, k best leaves, oversampling, stacking, two memories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.functions.columns import uniform
from tidemark.operators.baselines import class_list
from tidemark.operators.bayes import gaussian_nb
from tidemark.operators.neighbours import first_places, knn_class, nearest, nearest_of
from tidemark.operators.trees import EXTRA, Cells, Forest, Model, TreeSpec
from tidemark.plans.blocks import Blocks
from tidemark.plans.stream import Stream, prepare
from tidemark.session import written


class Shrubs(Forest):
    """At most ``members`` small trees, one fitted per block, with weights by proximal gradient steps
    (Buschjaeger, Hess and Morik 2022)."""

    def __init__(self, blocks, spec: TreeSpec, *args, levels: int = 2, rate: float = 0.5, **kwargs) -> None:
        super().__init__(blocks, replace(spec, members=0), *args, **kwargs)
        self.levels, self.pace, self.most = levels, rate, spec.members

    def model(self, learn: bool = False) -> tuple[Model, list]:
        model, nodes = super().model(learn)
        return ShrubModel(**vars(model)), nodes

    def extra_cells(self) -> int:
        return 3 * len(self.trees)

    @staticmethod
    def more(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient of the squared ensemble loss by member weight, size of the member's output, and rows."""
        v, _ = model.outputs_of(x)
        if model.spec.kind == "class":
            # a member pulls the share of its own class towards 1 where it is right, towards 0 elsewhere
            votes = np.stack([(v == c) @ model.weight for c in range(model.outputs)], 1)
            g = np.take_along_axis(votes, np.maximum(v, 0).astype(int), 1) - (v == y[:, None])
            size = np.ones_like(v)
        else:
            g, size = (v @ model.weight - y)[:, None] * v, v * v
        return np.stack([g.sum(0), size.sum(0), np.full(v.shape[1], float(len(y)))], 1).ravel()

    def learn_rows(self, rows: DataFrame) -> None:
        self.edges.add(rows)
        if self.trees:
            cells, _ = self.count(rows)
            pull = cells.get(-1, EXTRA, (len(self.trees), 3))
            step = pull[:, :2] / np.maximum(pull[:, 2:], 1.0)
            self.weight = np.maximum(self.weight - self.pace * step[:, 0] / np.maximum(step[:, 1], 1e-12), 0.0)
            self._trim()
        self._grow(rows)

    def _trim(self) -> None:
        """Weights back to a convex mix of the best trees; trees without weight go."""
        keep = np.argsort(-self.weight)[: self.most - 1]
        keep = sorted(i for i in keep if self.weight[i] > 1e-6)
        self.trees, self.weight = [self.trees[i] for i in keep], self.weight[keep]
        if len(keep):
            self.weight = self.weight / max(self.weight.sum(), 1e-12)

    def _grow(self, rows: DataFrame) -> None:
        """A tree of a few levels, fitted to this block alone, with a pass for each level."""
        spec = TreeSpec("shrub", kind=self.spec.kind, depth=self.spec.depth, tie=10.0, seed=self.spec.seed)
        small = Forest(self.blocks, spec, self.features, self.target, self.outputs)
        small.edges = self.edges
        for _ in range(self.levels):
            for node in small.trees[0].leaves():
                node.stats, node.hist = np.zeros(small.outputs), None
            small.learn(*small.count(rows))
        share = 1.0 / (len(self.trees) + 1)
        self.trees = [*self.trees, small.trees[0]]
        self.weight = np.append(self.weight * (1 - share), share)
        n = len(self.trees)
        self.background, self.right, self.wrong = [None] * n, np.zeros(n), np.zeros(n)


class ShrubModel(Model):
    """A regression is the weighted sum of the members, whose weights add up to 1 once trimmed."""

    def predict(self, x: np.ndarray, v: np.ndarray, walks: list) -> np.ndarray:
        if self.spec.kind == "class":
            return super().predict(x, v, walks)
        return v @ self.weight


class NearestLeaves(Forest):
    """Forest regressor that averages the k leaves nearest to the row; k by past error (Sun et al. 2022)."""

    centres = True

    def __init__(self, *args, **kwargs) -> None:
        super().__init__(*args, **kwargs)
        self.best = self.spec.members

    def model(self, learn: bool = False) -> tuple[Model, list]:
        model, nodes = super().model(learn)
        return LeafModel(**vars(model), best=self.best), nodes

    def extra_cells(self) -> int:
        return self.spec.members

    @staticmethod
    def more(model: Model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Summed absolute error of the mean of the 1, 2, ... nearest leaves."""
        return np.abs(model.means(x, *model.outputs_of(x)) - y[:, None]).sum(0)

    def learn(self, cells: Cells, nodes: list, only: int | None = None) -> None:
        miss = cells.get(-1, EXTRA, (self.spec.members,))
        if any(n.stats[0] > 0 for n in nodes[0]):  # else no tree has an output yet
            self.best = int(miss.argmin()) + 1
        super().learn(cells, nodes, only)


@dataclass
class LeafModel(Model):
    best: int = 1

    def means(self, x: np.ndarray, v: np.ndarray, walks: list) -> np.ndarray:
        """Mean output of the nearest leaves by their number; distance in bins to the mean of a leaf's rows."""
        bins, far = self.edges.bins_of(x), np.zeros(v.shape)
        for t, (row, leaf, main) in enumerate(walks):
            far[row[main], t] = ((bins[row[main]] - self.routes[t].centre[leaf[main]]) ** 2).sum(1)
        near = np.take_along_axis(v, np.argsort(far, axis=1, kind="stable"), 1)
        return near.cumsum(1) / np.arange(1, v.shape[1] + 1)

    def predict(self, x: np.ndarray, v: np.ndarray, walks: list) -> np.ndarray:
        return self.means(x, v[:, : self.members], walks[: self.members])[:, self.best - 1]


def oversampled(stream: Stream, features: list[str], minority: object, copies: int, k: int = 5, window: int = 1000, seed: int = 42) -> DataFrame:
    """The rows of a stream plus ``copies`` synthetic rows per minority row (Bernardo et al. 2020).

    A synthetic row lies between a minority row and one of its k nearest earlier minority rows; which one and
    where is decided by hashes. It carries the step of its row, so it is learned in the same block.
    """
    few = stream.df.filter(F.col(stream.target) == minority).select(F.col("step").alias("origin"), stream.target, *features)
    sub = prepare(few, ("origin",), stream.target, tuple(features))
    found = nearest(sub, features, k, window).filter(F.size("neighbours") > 0)
    copy = F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy")
    pick = found.select("step", "neighbours", copy)
    draw = uniform(F.lit(seed), F.col("copy"), F.col("step"))
    pick = pick.select("step", "copy", F.get("neighbours", F.floor(draw * F.size("neighbours")).cast("int"))["step"].alias("near"))
    here = sub.df.select("step", "origin", *[F.col(f).alias(f"a_{f}") for f in features])
    there = sub.df.select(F.col("step").alias("near"), *[F.col(f).alias(f"b_{f}") for f in features])
    both = pick.join(here, "step").join(there, "near")
    share = uniform(F.lit(seed + 1), F.col("copy"), F.col("step"))
    new = both.select(
        F.col("origin").alias("step"), F.lit(minority).alias(stream.target),
        *[(F.col(f"a_{f}") + share * (F.col(f"b_{f}") - F.col(f"a_{f}"))).alias(f) for f in features],
    )
    return stream.df.select("step", stream.target, *features).unionByName(new)


def stacking(blocks: Blocks, features: list[str], classes: list, index: Column, name: str = "stacking") -> DataFrame:
    """Predictions of naive Bayes, a tree and nearest neighbours as features of a forest.

    ``index`` is the class index of the target. Members are computed once and kept as a table.
    """
    stream = blocks.stream
    position = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    rows = gaussian_nb(stream, classes, features)
    rows = rows.withColumn("m_nb", F.element_at(position, F.col("naive_bayes")))
    rows = Forest(blocks, TreeSpec("m_tree"), features, index, len(classes)).run(rows=blocks.kept(rows, "stacking"))
    near = knn_class(nearest(stream, features, 5, 200), classes).select("step", F.element_at(position, F.col("knn")).alias("m_knn"))
    members = ["m_nb", "m_tree", "m_knn"]
    rows = rows.join(near, "step").withColumns({m: F.coalesce(m, F.lit(-1.0)) for m in members})
    keep = ["step", stream.target, *features, *members]
    # by blocks: without their own folders, every block would read the rows of all
    table = blocks.kept(rows.select(*dict.fromkeys(keep)), "stacking")
    level = Blocks(Stream(table.drop("_block"), stream.n, stream.target, tuple(members)), blocks.count)
    edges = [[c + 0.5 for c in range(-1, len(classes) - 1)]] * len(members)
    meta = Forest(level, TreeSpec(name, members=5, rate=6.0, leaf_subset=2, vote="accuracy"), members, index, len(classes), edges)
    return meta.run(rows=table)


def smallest(rows: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` rows of each block with the smallest ``u`` (ties by step), exactly: first in each partition, then over all."""

    def local(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for part in parts:
            both = part if best is None else pd.concat([best, part])
            best = both.sort_values(["u", "step"]).groupby("block", sort=False).head(cap)
        if best is not None:
            yield best

    few = rows.mapInPandas(local, rows.schema)
    place = F.row_number().over(Window.partitionBy("block").orderBy("u", "step"))
    return few.withColumn("_place", place).filter(F.col("_place") <= cap).drop("_place")


def long_memory(rows: DataFrame, states: list[list], classes: list, k: int) -> DataFrame:
    """``rows`` (y, x, block) with ``long_pred``: the vote of the k nearest rows of the memory before their block, the smaller label on
    ties of distance or of votes; NULL while that memory is empty. The memories are small and go with the job."""
    place = {c: i for i, c in enumerate(classes)}
    kept = []
    for memory in states:
        memory = sorted(memory, key=lambda r: place[r["y"]])
        kept.append((np.array([r["x"] for r in memory], float), np.array([place[r["y"]] for r in memory], np.int64)))

    def votes(x: np.ndarray, memory: np.ndarray, label: np.ndarray) -> np.ndarray:
        dist = np.zeros((len(x), len(memory)))
        for j in range(x.shape[1]):
            gap = x[:, j][:, None] - memory[:, j][None, :]
            dist += gap * gap
        # without a distance all rows of the memory are alike
        near, _ = first_places(np.nan_to_num(dist, nan=0.0, posinf=np.finfo(float).max), k)
        row = np.repeat(np.arange(len(x)), near.shape[1])
        count = np.bincount(row * len(classes) + label[near].ravel(), minlength=len(x) * len(classes))
        return count.reshape(len(x), -1).argmax(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            best = np.full(batch.num_rows, -1)
            for b in np.unique(block):
                memory, label = kept[b - 1]
                at = np.flatnonzero(block == b)
                for part in np.array_split(at, len(at) // 1024 + 1) if len(label) else []:
                    best[part] = votes(x[part], memory, label)
            y = batch.column("y")
            pred = pa.array(classes, y.type).take(pa.array(best, mask=best < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pred], [*batch.schema.names, "long_pred"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("long_pred", rows.schema["y"].dataType)]))


def two_memories(
    blocks: Blocks, features: list[str], windows: tuple[int, ...] = (50, 100, 200), k: int = 5, cap: int = 200, seed: int = 42, name: str = "sam"
) -> DataFrame:
    """Self-adjusting memory (Losing, Hammer and Wersing 2016) with block decisions.

    Short memory: nearest neighbours in the window length with the fewest errors in the block before. Long
    memory: a hash sample of all blocks before, at most ``cap`` rows (the size of that memory is the
    method), cleaned of rows that their short-memory neighbours contradict. The memory with fewer errors in
    the block before decides.
    """
    stream = blocks.stream
    target = stream.target
    classes = class_list(stream)
    rows = stream.df.withColumn("x", F.array(*[F.col(f).cast("double") for f in features]))
    rows = nearest_of(stream, features, k, {f"near_{w}": w for w in windows}, rows, keep=("x",))
    for w in windows:
        rows = knn_class(rows, classes, name=f"short_{w}", near=f"near_{w}")
    rows = written(rows.drop(*[f"near_{w}" for w in windows]).withColumn("block", blocks.number()), "memories")
    # long memory after block b: the cap rows with the smallest hash among the clean rows of blocks <= b
    clean = rows.filter(F.col(f"short_{windows[-1]}") == F.col("y"))
    drawn = smallest(clean.select("block", uniform(F.lit(seed), F.col("step")).alias("u"), "step"), cap)
    found = clean.drop("block").join(F.broadcast(drawn), "step")  # at most cap rows a block
    lists = found.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("u", "step", "x", "y"))).alias("l")).collect()
    memory, states = [], [[]]
    by_block = {r["block"]: r["l"] for r in lists}
    for b in range(1, blocks.used):
        memory = sorted([*memory, *by_block.get(b, [])], key=lambda r: (r["u"], r["step"]))[:cap]
        states.append(memory)
    scored = long_memory(rows, states, classes, k).drop("x")
    options = [f"short_{w}" for w in windows] + ["long_pred"]
    scored = written(scored, "memories")
    wrong = scored.groupBy("block").agg(*[F.avg((F.coalesce(F.col(o) != F.col("y"), F.lit(True))).cast("double")).alias(o) for o in options])
    pick = {r["block"] + 1: min(range(len(options)), key=lambda i: r[options[i]]) for r in wrong.collect()}
    choice = [{"pick": pick.get(b + 1, 0)} for b in range(blocks.used)]
    out = blocks.with_state(choice, "pick int", scored.drop("block"))
    return out.select("step", "y", F.get(F.array(*options), F.col("pick")).alias(name))
