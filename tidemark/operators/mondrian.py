"""Aggregated Mondrian forest (Mourtada, Gaiffas and Scornet 2021) with block updates.

The partitions are Mondrian processes (Lakshminarayanan, Roy and Teh 2014) that grow with the stream: every node has the box of the rows
that it has seen and the time of its split. When a block leaves a node's box, a new split may come above the node, at a time between its
parent's and its own and in the part of the range that is new; the node keeps its counts below that split. A job a block gives the box of
its rows, another the sums and the ranges by leaf, to which the boxes shrink; splits beside which no row was ever seen go. The driver
holds one state, whose size depends on the settings only.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.plans.blocks import Blocks
from tidemark.session import scratch_path

#: Leaves of a tree: the process stops there, as a finite budget of time would make it.
LEAVES = 64


class Cell:
    """A node of a partition: its box, the range of the rows seen in it while a leaf, the time of its split (infinite for a leaf), sums of its
    rows and its loss so far."""

    __slots__ = ("children", "cut", "feature", "high", "loss", "low", "seen", "sums", "time")

    def __init__(self, low: np.ndarray, high: np.ndarray, width: int) -> None:
        self.low, self.high, self.time = low.copy(), high.copy(), np.inf
        self.feature, self.cut, self.children = -1, 0.0, []
        self.sums, self.loss = np.zeros(width), 0.0
        self.seen: tuple[np.ndarray, np.ndarray] | None = None


class Partition:
    """One tree: grows with boxes, never with single rows, so the order of rows inside a block does not matter."""

    def __init__(self, rng: np.random.Generator, width: int, leaves: int = LEAVES) -> None:
        self.rng, self.width, self.most = rng, width, leaves
        self.root: Cell | None = None
        self.count, self.limit = 0, 0.0  # leaves, and the time up to which all splits are made

    def nodes(self) -> list[Cell]:
        """Parents before children."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            n = todo.pop()
            out.append(n)
            todo += n.children
        return out

    def extend(self, low: np.ndarray, high: np.ndarray) -> None:
        """Take in rows that lie in the box [low, high]. The tree then holds the earliest splits, as many as it has room for."""
        if self.root is None:
            self.root, self.count = Cell(low, high, self.width), 1
        self.root = self._extended(self.root, low, high, 0.0)
        while self.count > self.most:
            self._undo_last()
        self._refine()

    def _extended(self, node: Cell, low: np.ndarray, high: np.ndarray, after: float) -> Cell:
        """The node, or a new one above it where the rows outside its box bring an earlier split."""
        under, over = np.maximum(node.low - low, 0.0), np.maximum(high - node.high, 0.0)
        new = under + over
        if new.sum() > 0:
            time = after + self.rng.exponential() / new.sum()
            if time < (node.time if node.children else self.limit):
                f = int(self.rng.choice(len(new), p=new / new.sum()))
                at = float(self.rng.uniform(0, new[f]))
                above = Cell(np.minimum(low, node.low), np.maximum(high, node.high), self.width)
                # statistics are carried down: all rows so far lie on the old node's side
                above.time, above.feature, above.sums, above.loss = time, f, node.sums.copy(), node.loss
                side, inner_low, inner_high = Cell(low, high, self.width), low.copy(), high.copy()
                if at < under[f]:
                    above.cut = low[f] + at
                    side.high[f], inner_low[f] = min(high[f], above.cut), above.cut
                else:
                    above.cut = node.high[f] + at - under[f]
                    side.low[f], inner_high[f] = max(low[f], above.cut), above.cut
                if inner_low[f] <= inner_high[f]:  # else all new rows lie on the other side
                    node = self._extended(node, inner_low, inner_high, time)
                above.children = [side, node] if at < under[f] else [node, side]
                self.count += 1
                return above
        node.low, node.high = np.minimum(node.low, low), np.maximum(node.high, high)
        if node.children:
            f, cut, parts = node.feature, node.cut, []
            for j, child in enumerate(node.children):
                lo, hi = low.copy(), high.copy()
                if j == 0:
                    hi[f] = min(hi[f], cut)
                else:
                    lo[f] = max(lo[f], cut)
                parts.append(self._extended(child, lo, hi, node.time) if lo[f] <= hi[f] else child)
            node.children = parts
        return node

    def _undo_last(self) -> None:
        """Take back the latest split; both its sides are leaves, and the node holds the sums of both."""
        last = max((n for n in self.nodes() if n.children), key=lambda n: n.time)
        self.limit, self.count = last.time, self.count - 1
        last.time, last.feature, last.children = np.inf, -1, []

    def _refine(self) -> None:
        """Let the process run on until the tree has no room for another leaf: leaves compete with their side lengths as rates."""
        while self.count < self.most:
            leaves = [n for n in self.nodes() if not n.children]
            sides = np.array([np.maximum(n.high - n.low, 0.0) for n in leaves])
            if sides.sum() <= 0:
                break
            self.limit += self.rng.exponential() / sides.sum()
            at = int(self.rng.choice(sides.size, p=sides.ravel() / sides.sum()))
            self._halve(leaves[at // sides.shape[1]], self.limit, at % sides.shape[1])

    def shrink(self, ranges: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Take the boxes of leaves back to the rows seen in them, given the ranges of new rows by leaf; a split with an empty side goes."""
        for node in reversed(self.nodes()):  # children first
            if not node.children:
                if (new := ranges.get(id(node))) is not None:
                    node.seen = new if node.seen is None else (np.minimum(node.seen[0], new[0]), np.maximum(node.seen[1], new[1]))
                if node.seen is not None:
                    node.low, node.high = node.seen
                continue
            full = [c for c in node.children if c.children or c.seen is not None]
            if len(full) == 2:
                node.low, node.high = np.minimum(full[0].low, full[1].low), np.maximum(full[0].high, full[1].high)
                continue
            self.count -= 1
            only = full[0] if full else node.children[0]
            if not full and node.seen is not None:
                only.seen, only.low, only.high = node.seen, *node.seen
            # the node keeps its own sums, which hold all that the side that stays has, and the rows from before its split
            node.time, node.feature, node.cut, node.children, node.low, node.high = only.time, only.feature, only.cut, only.children, only.low, only.high
            node.seen = only.seen

    def _halve(self, node: Cell, time: float, f: int) -> None:
        cut = float(self.rng.uniform(node.low[f], node.high[f]))
        sides = Cell(node.low, node.high, self.width), Cell(node.low, node.high, self.width)
        sides[0].high[f] = sides[1].low[f] = cut
        node.time, node.feature, node.cut, node.children = time, f, cut, list(sides)
        self.count += 1


def compiled(nodes: list[Cell]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 for a leaf), cut and children by node."""
    place = {id(n): i for i, n in enumerate(nodes)}
    child = np.array([[place[id(c)] for c in n.children] or [0, 0] for n in nodes])
    return np.array([n.feature for n in nodes]), np.array([n.cut for n in nodes]), child


def leaf_of(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, child: np.ndarray) -> np.ndarray:
    at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
    open_ = open_[feature[at] >= 0]
    while len(open_):
        n = at[open_]
        at[open_] = child[n, (~(x[open_, feature[n]] <= cut[n])).astype(int)]
        open_ = open_[feature[at[open_]] >= 0]
    return at


def node_values(nodes: list[Cell], classes: int) -> np.ndarray:
    """What each node says by itself: class probabilities, or the mean (of the node above where there are no rows)."""
    sums = np.stack([n.sums for n in nodes])
    if classes:
        return (sums + 0.5) / (sums.sum(axis=1, keepdims=True) + 0.5 * classes)
    place, out = {id(n): i for i, n in enumerate(nodes)}, np.zeros(len(nodes))
    for i, n in enumerate(nodes):  # parents come first
        if sums[i, 0] > 0:
            out[i] = sums[i, 1] / sums[i, 0]
        for c in n.children:
            out[place[id(c)]] = out[i]
    return out[:, None]


def blended(nodes: list[Cell], value: np.ndarray, rate: float) -> np.ndarray:
    """What a row in each leaf gets: the mix of the nodes on its way, weighted by their losses."""
    place = {id(n): i for i, n in enumerate(nodes)}
    log_w = np.array([-rate * n.loss for n in nodes])
    log_tree = log_w.copy()
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i].children:
            below = sum(log_tree[place[id(c)]] for c in nodes[i].children)
            log_tree[i] = np.logaddexp(log_w[i], below) - np.log(2.0)
    mixed, above, left = value.copy(), np.zeros_like(value), np.ones(len(nodes))
    for i, n in enumerate(nodes):
        if n.children:
            own = np.exp(min(log_w[i] - np.log(2.0) - log_tree[i], 0.0))
            for c in n.children:
                j = place[id(c)]
                above[j] = above[i] + left[i] * own * value[i]
                left[j] = left[i] * (1.0 - own)
        mixed[i] = above[i] + left[i] * value[i]
    return mixed


def mondrian_forest(
    blocks: Blocks, features: list[str], target: Column, classes: int = 0, n_trees: int = 10, leaves: int = LEAVES, seed: int = 42, name: str = "mondrian"
) -> DataFrame:
    """The stream with the prediction, as a table: class index for ``classes`` > 0, otherwise the mean target.

    Missing features count as 0. Rows without a target are scored and not learned; they do not widen boxes.
    """
    rows, width, n = blocks.stream.df, classes or 3, len(features)
    trees = [Partition(np.random.default_rng([seed, t]), width, leaves) for t in range(n_trees)]
    inputs = [F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f"_f{i}") for i, f in enumerate(features)]
    path, out = scratch_path(rows.sparkSession, "mondrian"), None
    with ThreadPoolExecutor(1) as pool:
        for b in range(1, blocks.used + 1):
            here = blocks.rows(b, rows)
            out = _scored(here, inputs, trees, classes, name)
            writing = pool.submit(out.write.mode("append").parquet, path)
            if b < blocks.used:
                known = here.where(target.isNotNull()).select(*inputs, target.cast("double").alias("_y"))
                box = known.agg(F.count(F.lit(1)).alias("n"), *[g(f"_f{i}").alias(f"{g.__name__}{i}") for i in range(n) for g in (F.min, F.max)]).first()
                if box["n"]:
                    low, high = (np.array([box[f"{g}{i}"] for i in range(n)]) for g in ("min", "max"))
                    for t in trees:
                        t.extend(low, high)
                    _learn(known, trees, classes, n)
            writing.result()
    return rows.sparkSession.read.schema(out.schema).parquet(path) if out is not None else rows.withColumn(name, F.lit(None).cast("double"))


def _scored(rows: DataFrame, inputs: list[Column], trees: list[Partition], classes: int, name: str) -> DataFrame:
    state = []
    for t in trees:
        if nodes := t.nodes():
            spread = nodes[0].sums[2] / max(nodes[0].sums[0], 1.0) if not classes else 1.0
            state.append((compiled(nodes), blended(nodes, node_values(nodes, classes), 1.0 if classes else 1.0 / max(spread, 1e-12))))
    n = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(n)], 1)
            total = sum((mixed[leaf_of(x, *routes)] for routes, mixed in state), np.zeros((len(x), classes or 1)))
            if classes:
                pred = total.argmax(1).astype(float) if state else np.full(len(x), np.nan)
            else:
                pred = total[:, 0] / max(len(state), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, from_pandas=True)], ["_row", name])

    schema = StructType([StructField("_row", rows.schema), StructField(name, DoubleType())])
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    return rows.select(whole, *inputs).mapInArrow(run, schema).select("_row.*", name)


def _learn(known: DataFrame, trees: list[Partition], classes: int, n: int) -> None:
    """Add the block's sums to the nodes, after the losses of what the nodes said before it, and shrink boxes to the rows seen."""
    nodes = [t.nodes() for t in trees]
    routes, width = [compiled(some) for some in nodes], classes or 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(f), width)) for f, _, _ in routes]
        low, high = ([np.full((len(f), n), side) for f, _, _ in routes] for side in (np.inf, -np.inf))
        for batch in batches:
            c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n + 1)]
            x, y = np.stack(c[:n], 1), c[n]
            for t, r in enumerate(routes):
                leaf = leaf_of(x, *r)
                if classes:
                    np.add.at(sums[t], (leaf, y.astype(int)), 1.0)
                else:
                    np.add.at(sums[t], leaf, np.stack([np.ones(len(y)), y, y * y], 1))
                np.minimum.at(low[t], leaf, x)
                np.maximum.at(high[t], leaf, x)
        for t in range(len(routes)):
            for kind, cells, some in ((0, sums[t], sums[t] != 0), (1, low[t], np.isfinite(low[t])), (2, high[t], np.isfinite(high[t]))):
                at, v = np.flatnonzero(some), cells[some]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at), pa.array(v)], ["tree", "kind", "cell", "v"])

    made = known.mapInArrow(run, "tree int, kind int, cell bigint, v double").groupBy("tree", "kind", "cell")
    cells = made.agg(F.sum("v").alias("v"), F.min("v").alias("low"), F.max("v").alias("high")).toPandas()  # a row a leaf and class or feature
    for t, some in enumerate(nodes):
        new, low, high = np.zeros((len(some), width)), np.full((len(some), n), np.inf), np.full((len(some), n), -np.inf)
        for kind, (out, column) in enumerate(((new, "v"), (low, "low"), (high, "high"))):
            mine = cells[(cells["tree"] == t) & (cells["kind"] == kind)]
            out.ravel()[mine["cell"].to_numpy()] = mine[column].to_numpy()
        place = {id(node): i for i, node in enumerate(some)}
        for i in range(len(some) - 1, -1, -1):
            for c in some[i].children:
                new[i] += new[place[id(c)]]
        value = node_values(some, classes)
        for node, s, v in zip(some, new, value, strict=True):
            node.loss += float(-(s * np.log(v)).sum()) if classes else max(float(s[2] - 2 * v[0] * s[1] + v[0] ** 2 * s[0]), 0.0)
            node.sums = node.sums + s
        trees[t].shrink({id(node): (low[i], high[i]) for i, node in enumerate(some) if not node.children and np.isfinite(low[i]).all()})
