"""Decision trees and ensembles of trees, grown block by block.

A tree is a table of nodes: a split names a feature, a cut and two children, an option node several splits, and a node
under suspicion of drift a second subtree that grows beside it. A block is scored with the trees of the blocks before
and written; another job routes its rows in Arrow batches and counts histograms of the leaves that still learn, by task
first, then by cell. The driver sees cells, whose number depends on the settings only, and keeps the last state alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.operators.drift import BlockAdwin
from tidemark.operators.edges import BINS, Edges, carried, value
from tidemark.plans.blocks import Blocks
from tidemark.session import scratch_path

LEAF, OPTION = -1, -2
#: Histogram cells of all trees together; beyond it fewer leaves of each tree learn at a time.
MAX_CELLS = 20_000_000
#: Kinds of cells that a job counts: histograms, sums by leaf, errors by leaf, errors by tree, errors of the vote, and what subclasses add.
HIST, STAT, LEAF_ERROR, TREE_ERROR, VOTE, EXTRA = range(6)
CELLS = "tree int, kind int, cell bigint, v double, top double"


@dataclass
class TreeSpec:
    """Settings of a tree or of an ensemble of trees.

    ``kind``: ``class``, ``reg`` (variance reduction) or ``gradient`` (additive trees on loss gradients).
    """

    name: str
    kind: str = "class"
    members: int = 1
    rate: float = 0.0  # Poisson rate of the row weights, 0 = every row once
    subset: int | None = None  # features per member
    leaf_subset: int | None = None  # features per leaf
    depth: int | None = None  # none: trees grow as far as the bound lets them
    active: int = 256  # leaves of a tree that hold histograms at a time, the most promising ones
    delta: float = 1e-7
    tie: float = 0.05
    options: int = 0  # splits that a tree may add as options where the best ones tie
    revisit: bool = False  # re-check splits that are no longer best
    on_drift: str | None = None  # of a subtree: grow an ``alternate`` beside it, or ``cut`` it off
    reset: str | None = None  # on drift restart the ``member`` itself or the ``worst`` one
    warn: float = 0.01  # with ``reset="member"``: level at which a background tree starts
    drift: float = 0.002  # and the level of drift
    boost: str | None = None  # row weights from earlier members: ``oza`` or ``smooth``
    vote: str = "equal"  # ``equal``, ``accuracy``, ``log_odds`` or ``majority`` (members come and go by their errors)
    most: int = 25  # members of a ``majority`` vote
    shrink: float = 0.3  # step of additive trees
    ridge: float = 1.0
    log_loss: bool = False  # gradient trees on 0/1 targets
    seed: int = 42


class Node:
    """A leaf, a split (two children) or an option node (several splits)."""

    __slots__ = ("alt", "centre", "children", "cut", "depth", "drift", "feature", "hist", "learns", "race", "serial", "stats", "value")

    def __init__(self, serial: int, depth: int, stats: np.ndarray, value: float = 0.0, centre: np.ndarray | None = None) -> None:
        self.serial, self.depth, self.stats, self.value, self.centre = serial, depth, stats, value, centre
        self.feature, self.cut, self.children = LEAF, 0.0, []
        self.hist: np.ndarray | None = None
        self.learns = True
        self.drift: BlockAdwin | None = None
        self.alt: Node | None = None
        self.race: np.ndarray | None = None  # (weight, error, squared error) of the node and of its alternate since that began

    def become(self, other: "Node") -> None:
        for name in self.__slots__:
            if name not in ("serial", "depth"):
                setattr(self, name, getattr(other, name))

    def below(self) -> list["Node"]:
        """The node and its descendants, without alternates."""
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            out.append(n)
            todo += n.children
        return out

    def leaves(self) -> list["Node"]:
        return [n for n in self.below() if n.feature == LEAF]


@dataclass
class Tree:
    """One member on the driver."""

    outputs: int
    features: set[int]
    made: int = 0
    options: int = 0
    root: Node | None = None
    errors: tuple[float, float] = (0.0, 0.0)  # weight and error of the last block

    def __post_init__(self) -> None:
        self.root = self.leaf(0)

    def leaf(self, depth: int, stats: np.ndarray | None = None, value: float = 0.0, centre: np.ndarray | None = None) -> Node:
        self.made += 1
        return Node(self.made, depth, np.zeros(self.outputs) if stats is None else stats, value, centre)

    def nodes(self) -> list[Node]:
        """All nodes, those of alternates last."""
        main = self.root.below()
        return main + [n for m in main if m.alt for n in m.alt.below()]

    def leaves(self) -> list[Node]:
        return [n for n in self.nodes() if n.feature == LEAF]


@dataclass
class Routes:
    """A tree as arrays, in the order of its nodes."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray  # [node, side]
    options: dict[int, np.ndarray]
    alt: np.ndarray
    value: np.ndarray
    slot: np.ndarray  # place of a learning leaf's histogram, else -1
    slots: int
    centre: np.ndarray | None = None

    @classmethod
    def of(cls, nodes: list[Node], values: np.ndarray, centres: bool, learn: bool) -> "Routes":
        place = {id(n): i for i, n in enumerate(nodes)}
        child = np.zeros((len(nodes), 2), np.int64)
        options, alt, slot, slots = {}, np.full(len(nodes), -1), np.full(len(nodes), -1), 0
        for i, n in enumerate(nodes):
            if n.feature >= 0:
                child[i] = [place[id(c)] for c in n.children]
            elif n.feature == OPTION:
                options[i] = np.array([place[id(c)] for c in n.children])
            elif n.learns and learn:
                slot[i], slots = slots, slots + 1
            if n.alt:
                alt[i] = place[id(n.alt)]
        centre = np.stack([n.centre for n in nodes]) if centres else None
        return cls(np.array([n.feature for n in nodes]), np.array([n.cut for n in nodes]), child, options, alt, values, slot, slots, centre)

    def walk(self, x: np.ndarray, alternates: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, whether the leaf belongs to the tree itself). A row reaches a leaf for each option on its way."""
        row, node, main = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), bool)
        out = []
        while len(row):
            more = []
            if alternates:
                second = self.alt[node]
                if (hit := second >= 0).any():
                    more.append((row[hit], second[hit], np.zeros(int(hit.sum()), bool)))
            f = self.feature[node]
            if (ends := f == LEAF).any():
                out.append((row[ends], node[ends], main[ends]))
            if (splits := f >= 0).any():
                r, n = row[splits], node[splits]
                more.append((r, self.child[n, (~(x[r, f[splits]] <= self.cut[n])).astype(int)], main[splits]))
            for i, ways in self.options.items():
                if (hit := node == i).any():
                    more += [(row[hit], np.full(int(hit.sum()), way), main[hit]) for way in ways]
            row, node, main = (np.concatenate(c) for c in zip(*more, strict=True)) if more else (row[:0], node[:0], main[:0])
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (row, node, main)

    def values(self, n: int, row: np.ndarray, leaf: np.ndarray, main: np.ndarray) -> np.ndarray:
        """The tree's output by row: its leaf's value, or the mean over the leaves of all options."""
        row, got = row[main], self.value[leaf[main]]
        if not self.options:
            out = np.zeros(n)
            out[row] = got
            return out
        return np.bincount(row, got, n) / np.bincount(row, minlength=n)


def draws(seed: int, member: int, step: np.ndarray, rate: float) -> np.ndarray:
    """Poisson weights from a hash of (seed, member, step): the same on every run and partitioning."""
    z = step.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xBF58476D1CE4E5B9 + (member + 1) * 0x94D049BB133111EB) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)
    term, total, ends = math.exp(-rate), 0.0, []
    for k in range(30):
        total += term
        ends.append(total)
        term *= rate / (k + 1)
    return np.searchsorted(ends, u, side="right").astype(float)


@dataclass
class Model:
    """What a task needs to score rows and to count cells: plain arrays, sent with the job."""

    spec: TreeSpec
    outputs: int
    edges: Edges
    routes: list[Routes]
    weight: np.ndarray
    right: np.ndarray
    wrong: np.ndarray
    owner: list[int]  # member of each tree; background trees come last and have that of the tree that they may replace

    @property
    def members(self) -> int:
        return len(self.weight)

    def outputs_of(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        walks = [r.walk(x, self.spec.on_drift == "alternate") for r in self.routes]
        return np.stack([r.values(len(x), *w) for r, w in zip(self.routes, walks, strict=True)], 1) if walks else np.zeros((len(x), 0)), walks

    def predict(self, x: np.ndarray, v: np.ndarray, walks: list) -> np.ndarray:
        """The ensemble's prediction by row; NaN where no member has one."""
        spec, v = self.spec, v[:, : self.members]
        if spec.kind == "gradient":
            total = v.sum(1)
            return (total > 0).astype(float) if spec.log_loss else total
        if not self.members:
            return np.full(len(x), np.nan)
        if spec.kind == "reg":
            return v @ self.weight / self.weight.sum()
        votes = np.stack([(v == c) @ self.weight for c in range(self.outputs)], 1)
        return np.where(votes.max(1) > 0, votes.argmax(1), np.nan)

    def row_weights(self, y: np.ndarray, v: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Weights by row and tree."""
        spec = self.spec
        w = np.stack([draws(spec.seed, m, step, spec.rate) if spec.rate > 0 else np.ones(len(y)) for m in self.owner], 1)
        if spec.boost == "oza":
            # passed from member to member: up after a wrong prediction, down after a right one
            now = np.ones(len(y))
            for i in range(self.members):
                w[:, i] *= now
                total = self.right[i] + self.wrong[i]
                down = total / (2 * self.right[i]) if self.right[i] > 0 else 1.0
                up = total / (2 * self.wrong[i]) if self.wrong[i] > 0 else 1.0
                now = np.where(v[:, i] < 0, now, now * np.where(v[:, i] == y, down, up))
        elif spec.boost == "smooth":
            # smooth boosting keeps a margin z per row: weight = min(1, (1 - gamma) ** (z / 2))
            gamma, theta, z = 0.1, 0.1 / 2.1, np.zeros(len(y))
            for i in range(self.members):
                w[:, i] *= np.minimum(1.0, (1 - gamma) ** (z / 2))
                z = z + np.where(v[:, i] == y, 1.0, -1.0) - theta
        return w

    def payload(self, y: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Sums that a regression or gradient tree keeps, for one tree's weights: (weight, first, second)."""
        if self.spec.kind == "gradient":
            f = v[:, : self.members].sum(1)
            if self.spec.log_loss:
                p = 1.0 / (1.0 + np.exp(-f))
                return np.stack([w, p - y, p * (1.0 - p)], 1)
            return np.stack([w, f - y, np.ones(len(y))], 1)
        return np.stack([w, w * y, w * y * y], 1)


class Counter:
    """Cells of one task."""

    def __init__(self, model: Model, n_features: int, only: int | None, extra: int) -> None:
        self.model, self.only, k = model, only, model.outputs
        self.which = range(len(model.routes)) if only is None else [only]
        self.hist = {t: np.zeros((n_features, model.routes[t].slots * BINS * k)) for t in self.which}
        self.stat = {t: np.zeros((len(model.routes[t].feature), k)) for t in self.which}
        self.leaf_error = {t: np.zeros((len(model.routes[t].feature), 4)) for t in self.which}  # weight, error, its square, largest
        self.tree_error = {t: np.zeros(6) for t in self.which}  # the same, then weights of right and wrong rows
        self.vote = np.zeros(2 + k)
        self.extra = np.zeros(extra)

    def add(self, x: np.ndarray, y: np.ndarray, step: np.ndarray) -> None:
        model, spec, k = self.model, self.model.spec, self.model.outputs
        v, walks = model.outputs_of(x)
        bins, weights = model.edges.bins_of(x), model.row_weights(y, v, step)
        for t in self.which:
            row, leaf, main = walks[t]
            w, route = weights[:, t], model.routes[t]
            slot = route.slot[leaf]
            on = slot >= 0
            r, s = row[on], slot[on]
            if spec.kind == "class":
                c = y.astype(int)
                np.add.at(self.stat[t], (leaf, c[row]), w[row])
                for f in range(bins.shape[1]):
                    self.hist[t][f] += np.bincount((s * BINS + bins[r, f]) * k + c[r], w[r], self.hist[t].shape[1])
                wrong = v[:, t] != y
                self._error(t, np.ones(len(y)), wrong.astype(float))
                self.tree_error[t][4:] += [w[~wrong].sum(), w[wrong].sum()]
                miss, by = (route.value[leaf] != y[row]).astype(float), np.ones(len(row))
            else:
                pay = model.payload(y, w, v)
                np.add.at(self.stat[t], leaf, pay[row])
                for f in range(bins.shape[1]):
                    for j in range(k):
                        self.hist[t][f] += np.bincount((s * BINS + bins[r, f]) * k + j, pay[r, j], self.hist[t].shape[1])
                self._error(t, w, (v[:, t] - y) ** 2)
                miss, by = (route.value[leaf] - y[row]) ** 2, w[row]
            if spec.on_drift:
                np.add.at(self.leaf_error[t][:, :3], leaf, np.stack([by, by * miss, by * miss * miss], 1))
                np.maximum.at(self.leaf_error[t][:, 3], leaf, miss)
        if spec.kind == "class":
            voted = model.predict(x, v, walks)
            self.vote[:2] += [len(y), (voted != y).sum()]
            self.vote[2:] += np.bincount(y.astype(int), minlength=k)

    def _error(self, t: int, w: np.ndarray, e: np.ndarray) -> None:
        out = self.tree_error[t]
        out[:3] += [w.sum(), (w * e).sum(), (w * e * e).sum()]
        out[3] = max(out[3], e.max(initial=0.0))

    def cells(self) -> Iterator[pd.DataFrame]:
        def frame(tree: int, kind: int, cells: np.ndarray) -> pd.DataFrame:
            flat = cells.ravel()
            some = np.flatnonzero(flat)
            return pd.DataFrame({"tree": np.int32(tree), "kind": np.int32(kind), "cell": some, "v": flat[some], "top": flat[some]})

        for t in self.which:
            yield frame(t, HIST, self.hist[t])
            yield frame(t, STAT, self.stat[t])
            yield frame(t, LEAF_ERROR, self.leaf_error[t])
            yield frame(t, TREE_ERROR, self.tree_error[t])
        yield frame(-1, VOTE, self.vote)
        yield frame(-1, EXTRA, self.extra)


@dataclass
class Cells:
    """Summed cells of a block, on the driver."""

    rows: pd.DataFrame
    groups: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.groups = dict(list(self.rows.groupby(["tree", "kind"])))

    def get(self, tree: int, kind: int, shape: tuple[int, ...], top: int | None = None) -> np.ndarray:
        """An array of sums; the last column ``top`` holds maxima."""
        out = np.zeros(shape)
        part = self.groups.get((tree, kind))
        if part is not None:
            flat, cell = out.ravel(), part["cell"].to_numpy()
            flat[cell] = part["v"].to_numpy()
            if top is not None:
                most = cell % shape[-1] == top
                flat[cell[most]] = part["top"].to_numpy()[most]
        return out


def majority_weights(weight: np.ndarray, wrong: np.ndarray, n: float, vote_wrong: float, chance: float, decay: float = 0.5, least: float = 0.01) -> tuple[np.ndarray, np.ndarray, bool]:
    """Dynamic weighted majority (Kolter and Maloof 2007) with a block as its period: members that err more often than ``chance`` (the error of
    always naming the block's largest class) lose by ``decay``, weights are scaled to a largest of 1, members below ``least`` go.
    Gives the new weights, who stays, and whether a member is added as the vote itself erred more than by chance."""
    new = np.where(wrong / n > chance, weight * decay, weight)
    new = new / new.max() if len(new) else new
    return new, new >= least, vote_wrong / n > chance


class Forest:
    """Fits a TreeSpec over blocks and scores every block with the trees of the blocks before."""

    centres = False

    def __init__(self, blocks: Blocks, spec: TreeSpec, features: list[str], target: Column, outputs: int = 3, edges: list[list[float]] | None = None) -> None:
        self.blocks, self.spec, self.features, self.target = blocks, spec, features, target
        self.outputs = outputs if spec.kind == "class" else 3
        self.edges = Edges(features, fixed=edges)
        self.rng = np.random.default_rng(spec.seed)
        self.trees = [self.new_tree() for _ in range(spec.members)]
        self.background: list[Tree | None] = [None] * spec.members
        self.weight = np.ones(spec.members)
        self.right, self.wrong = np.zeros(spec.members), np.zeros(spec.members)  # boosting sums
        self.adwin, self.warning = ([BlockAdwin(d) for _ in range(spec.members)] for d in (spec.drift, spec.warn))

    def new_tree(self) -> Tree:
        n = len(self.features)
        out = Tree(self.outputs, set(self.rng.choice(n, min(self.spec.subset or n, n), replace=False).tolist()))
        if self.centres:
            out.root.centre = np.full(n, BINS / 2.0)
        return out

    # ------------------------------------------------------------ the state as arrays

    def leaf_values(self, nodes: list[Node]) -> np.ndarray:
        s = np.stack([n.stats for n in nodes])
        if self.spec.kind == "class":
            return np.where(s.sum(axis=1) > 0, s.argmax(axis=1), -1).astype(float)
        if self.spec.kind == "reg":
            return np.divide(s[:, 1], s[:, 0], out=np.zeros(len(s)), where=s[:, 0] > 0)
        return np.array([n.value for n in nodes])

    def model(self, learn: bool = False) -> tuple[Model, list[list[Node]]]:
        """The trees as arrays, and the nodes that their rows stand for; with background trees if rows are to be learned."""
        trees = list(enumerate(self.trees)) + [(i, t) for i, t in enumerate(self.background) if t and learn]
        nodes = [t.nodes() for _, t in trees]
        routes = [Routes.of(n, self.leaf_values(n), self.centres, learn) for n in nodes]
        return Model(self.spec, self.outputs, self.edges, routes, self.weight.copy(), self.right.copy(), self.wrong.copy(), [i for i, _ in trees]), nodes

    # ------------------------------------------------------------ jobs

    def extra_cells(self) -> int:
        return 0

    def _inputs(self) -> list[Column]:
        return [value(f).alias(f"_f{i}") for i, f in enumerate(self.features)]

    def count(self, rows: DataFrame, only: int | None = None) -> tuple[Cells, list[list[Node]]]:
        """Cells of some rows; of one tree if it is named. Rows without a target are not learned."""
        model, nodes = self.model(learn=True)
        n, extra, more = len(self.features), self.extra_cells(), self.more

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = Counter(model, n, only, extra)
            for batch in batches:
                if batch.num_rows:
                    c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n + 2)]
                    x = np.stack(c[:n], 1)
                    counter.add(x, c[n], c[n + 1])
                    if extra:
                        counter.extra += more(model, x, c[n])
            for frame in counter.cells():
                yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

        inputs = rows.where(self.target.isNotNull()).select(*self._inputs(), self.target.cast("double").alias("_y"), F.col("step").cast("bigint"))
        cells = inputs.mapInArrow(run, CELLS).groupBy("tree", "kind", "cell").agg(F.sum("v").alias("v"), F.max("top").alias("top"))
        return Cells(cells.toArrow().to_pandas()), nodes

    more = None  # of a subclass: extra sums by batch, as a plain function of (model, x, y)

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the prediction of the present trees."""
        model, _ = self.model()
        n, name = len(self.features), self.spec.name

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(n)], 1)
                pred = model.predict(x, *model.outputs_of(x))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, from_pandas=True)], ["_row", name])

        schema = StructType([StructField("_row", rows.schema), StructField(name, DoubleType())])
        inputs = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), *self._inputs())
        return inputs.mapInArrow(run, schema).select("_row.*", name)

    def learn_rows(self, rows: DataFrame) -> None:
        """Learn the rows of a block: edges first, then histograms. Additive trees learn one after another, each at the prediction that the one before left."""
        if (moved := self.edges.add(rows)) is not None:
            self._carry(moved)
        for only in range(len(self.trees)) if self.spec.kind == "gradient" else [None]:
            self.learn(*self.count(rows, only), only)

    def run(self, learn: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
        """All rows with a prediction, each from the trees before its block, as a table. ``learn`` gives other rows to learn from
        (default: the stream itself), ``rows`` other rows to score; both need ``step``, and should be kept tables."""
        source = self.blocks.stream.df if rows is None else rows
        path = scratch_path(source.sparkSession, "scored")
        out = None
        with ThreadPoolExecutor(1) as pool:
            for b in range(1, self.blocks.used + 1):
                # both jobs of a block use the same state, so they run side by side
                out = self.scored(self.blocks.rows(b, source))
                writing = pool.submit(out.write.mode("append").parquet, path)
                if b < self.blocks.used:
                    self.learn_rows(self.blocks.rows(b, source if learn is None else learn))
                writing.result()
        return source.sparkSession.read.schema(out.schema).parquet(path) if out is not None else self.scored(source)

    # ------------------------------------------------------------ driver side, cells only

    def _all(self) -> list[Tree]:
        return self.trees + [t for t in self.background if t]

    def _carry(self, moved: list[np.ndarray | None]) -> None:
        for tree in self._all():
            for node in tree.nodes():
                if node.hist is not None:
                    node.hist = carried(node.hist, moved)

    def learn(self, cells: Cells, nodes: list[list[Node]], only: int | None = None) -> None:
        trees, k, n_features = self._all(), self.outputs, len(self.features)
        owners = list(range(len(self.trees))) + [i for i, t in enumerate(self.background) if t]
        for t, tree in enumerate(trees):
            if only is not None and t != only:
                continue
            mine = nodes[t]
            slots = [n for n in mine if n.feature == LEAF and n.learns]
            hist = cells.get(t, HIST, (n_features, len(slots), BINS, k))
            stat = cells.get(t, STAT, (len(mine), k))
            if t < len(self.trees):
                self._measure(t, cells.get(t, TREE_ERROR, (6,), top=3))
            for node, s in zip(mine, stat, strict=True):
                if self.spec.kind == "gradient":
                    node.stats = s  # gradients age with the model, so only the block itself counts
                else:
                    node.stats = node.stats + s
            for i, node in enumerate(slots):
                h = hist[:, i]
                node.hist = h if node.hist is None or self.spec.kind == "gradient" else node.hist + h
                if self.centres and h[0, :, 0].sum() > 0:
                    node.centre = self._middle(node.hist)
            if self.spec.revisit:
                self._pass_up(tree.root, dict(zip(map(id, slots), hist.swapaxes(0, 1), strict=True)))
            if self.spec.on_drift:
                self._suspect(tree, dict(zip(map(id, mine), cells.get(t, LEAF_ERROR, (len(mine), 4), top=3), strict=True)))
            self._split(owners[t], tree)
            self._choose(tree, len(trees))
        if only is None:
            self._restart(cells)

    @staticmethod
    def _middle(hist: np.ndarray) -> np.ndarray:
        """Mean bin of each feature."""
        n = hist[:, :, 0]
        return (n * np.arange(BINS)).sum(1) / np.maximum(n.sum(1), 1e-12)

    def _pass_up(self, node: Node, new: dict[int, np.ndarray]):
        """Add what the leaves below got to the histograms of inner nodes."""
        if node.feature == LEAF:
            return new.get(id(node), 0)
        got = sum(self._pass_up(c, new) for c in node.children)
        if not isinstance(got, int):
            node.hist = got if node.hist is None else node.hist + got
        return got

    def _measure(self, i: int, error: np.ndarray) -> None:
        """Errors of the predictions made before this block was learned."""
        n, e, sq, top, right, wrong = error
        tree, spec = self.trees[i], self.spec
        tree.errors = (n, e)
        if spec.kind == "class":
            self.right[i] += right
            self.wrong[i] += wrong
        if n <= 0 or spec.kind == "gradient":
            return
        if spec.vote == "accuracy":
            self.weight[i] = max(1e-6, 1 - e / n) if spec.kind == "class" else 1.0 / (1e-9 + e / n)
        elif spec.vote == "log_odds":
            share = min(max(self.wrong[i] / max(self.right[i] + self.wrong[i], 1e-9), 1e-6), 1 - 1e-6)
            self.weight[i] = max(1e-3, math.log((1 - share) / share) + math.log(max(self.outputs - 1, 1)))

    # ------------------------------------------------------------ drift below a node

    def _suspect(self, tree: Tree, errors: dict[int, np.ndarray]) -> None:
        """Watch the errors of every subtree. Where they rise, cut it off, or grow an alternate beside the lowest node that shows it and keep the better one."""
        inner = [n for n in tree.root.below() if n.feature != LEAF]  # parents first
        if self.spec.on_drift == "cut":
            gone: set[int] = set()
            for node in inner:
                own = self._sum(node, errors)
                if id(node) not in gone and own[0] > 0 and self._watched(node, own):
                    gone |= {id(n) for n in node.below()}
                    self._collapse(node)
            return
        busy: set[int] = set()
        for node in reversed(inner):
            own = self._sum(node, errors)
            rose = own[0] > 0 and self._watched(node, own)
            explained = any(id(c) in busy for c in node.children)
            if rose or explained or node.alt:
                busy.add(id(node))
            if node.alt is None:
                if rose and not explained:
                    node.alt, node.race = tree.leaf(node.depth, centre=node.centre), None
            elif node.race is None:
                node.race = np.zeros((2, 3))  # the alternate has just learned its first block, so it starts from here
            else:
                node.race += np.stack([own[:3], self._sum(node.alt, errors)[:3]])
                verdict = self._race(node.race)
                if verdict > 0:
                    node.become(node.alt)
                elif verdict < 0:
                    node.alt = node.race = None

    def _watched(self, node: Node, own: np.ndarray) -> bool:
        if node.drift is None:
            node.drift = BlockAdwin(self.spec.drift)
        return node.drift.add(*own)

    @staticmethod
    def _race(race: np.ndarray, least: float = 300.0, risk: float = 0.05) -> int:
        """1 if the alternate's mean error is surely smaller, -1 if surely larger, 0 while that is open."""
        if race[:, 0].min() < least:
            return 0
        n, mean = race[:, 0], race[:, 1] / race[:, 0]
        spread = np.maximum(race[:, 2] / n - mean**2, 0.0)
        bound = math.sqrt(2 * math.log(2 / risk) * (spread / n).sum())
        return int(np.sign(mean[0] - mean[1])) if abs(mean[0] - mean[1]) > bound else 0

    def _sum(self, node: Node, errors: dict[int, np.ndarray]) -> np.ndarray:
        rows = np.array([errors[id(n)] for n in node.leaves() if id(n) in errors])
        return np.append(rows[:, :3].sum(0), rows[:, 3].max()) if len(rows) else np.zeros(4)

    def _collapse(self, node: Node) -> None:
        """Turn a node into a leaf that keeps the statistics of what was below it."""
        node.stats = sum(n.stats for n in node.leaves())
        node.feature, node.children, node.hist, node.drift, node.learns = LEAF, [], None, None, True

    # ------------------------------------------------------------ splits

    def _best(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain and place of the best cut of every feature, for many nodes at a time: [node, feature, bin, output]."""
        left, total = h.cumsum(axis=2)[:, :, :-1], h.sum(axis=2)
        gain = self._gain(left, total[:, :, None] - left, total)
        cut = gain.argmax(axis=2)
        return np.take_along_axis(gain, cut[:, :, None], 2)[:, :, 0], cut

    def _gains(self, gain: np.ndarray, cut: np.ndarray, allowed) -> list[tuple[float, int, int]]:
        """Best cut of every feature of a node as (gain, feature, cut), best first."""
        out = [(float(gain[f]), f, int(cut[f])) for f in sorted(allowed) if np.isfinite(gain[f]) and cut[f] < len(self.edges.of[f])]
        return sorted(out, key=lambda g: -g[0])

    def _gain(self, left, right, total):
        few = 1e-9
        if self.spec.kind == "class":
            def entropy(c):
                n = c.sum(axis=-1, keepdims=True)
                p = np.divide(c, n, out=np.zeros_like(c), where=n > few)
                return -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=-1)

            nl, nr, n = left.sum(axis=-1), right.sum(axis=-1), total.sum(axis=-1)[..., None]
            gain = entropy(total)[..., None] - (nl * entropy(left) + nr * entropy(right)) / np.maximum(n, 1e-12)
        elif self.spec.kind == "reg":
            def deviation(c):
                mean = np.divide(c[..., 1], c[..., 0], out=np.zeros_like(c[..., 0]), where=c[..., 0] > few)
                var = np.divide(c[..., 2], c[..., 0], out=np.zeros_like(c[..., 0]), where=c[..., 0] > few) - mean * mean
                return np.sqrt(np.maximum(var, 0.0))

            nl, nr, n = left[..., 0], right[..., 0], total[..., 0][..., None]
            gain = deviation(total)[..., None] - (nl * deviation(left) + nr * deviation(right)) / np.maximum(n, 1e-12)
        else:
            nl, nr = left[..., 0], right[..., 0]
            score = lambda c: c[..., 1] ** 2 / (c[..., 2] + self.spec.ridge)
            gain = score(left) + score(right) - score(total)[..., None]
        return np.where((nl > few) & (nr > few), gain, -np.inf)

    def _bound(self, n: float) -> float:
        span = math.log2(max(self.outputs, 2)) if self.spec.kind == "class" else 1.0
        return math.sqrt(span * span * math.log(1 / self.spec.delta) / (2 * max(n, 1.0)))

    def _may_split(self, gains, n: float) -> str | None:
        """``clear`` if the best cut is surely the best, ``tie`` if the best ones are too close to matter, else None."""
        best, second = gains[0][0], max(gains[1][0], 0.0) if len(gains) > 1 else 0.0
        if best <= 0:
            return None
        bound = self._bound(n)
        if self.spec.kind == "gradient":
            return "clear" if best > 1e-6 else None
        gap = best - second if self.spec.kind == "class" else 1 - second / best
        return "clear" if gap > bound else "tie" if bound < self.spec.tie else None

    def _step(self, sums: np.ndarray) -> float:
        """Newton step for (n, gradient, hessian), shortened."""
        return -self.spec.shrink * float(sums[1] / (sums[2] + self.spec.ridge))

    def _size(self, h: np.ndarray) -> float:
        return float(h[0].sum() if self.spec.kind == "class" else h[0, :, 0].sum())

    def _divide(self, tree: Tree, node: Node, h: np.ndarray, feature: int, cut: int) -> None:
        node.feature, node.cut = feature, self.edges.cut(feature, cut)
        sides = h[feature][: cut + 1].sum(axis=0), h[feature][cut + 1 :].sum(axis=0)
        node.children = [tree.leaf(node.depth + 1, side, node.value + self._step(side) if self.spec.kind == "gradient" else 0.0, node.centre) for side in sides]
        if self.centres:
            for j, child in enumerate(node.children):
                child.centre = node.centre.copy()
                bins, n = np.arange(BINS), h[feature][:, 0].copy()
                n[slice(cut + 1, None) if j == 0 else slice(0, cut + 1)] = 0
                child.centre[feature] = (n * bins).sum() / max(n.sum(), 1e-12)
        node.drift = None

    def _split(self, member: int, tree: Tree) -> None:
        spec, nodes = self.spec, tree.nodes()
        held = [n for n in nodes if n.hist is not None]
        best = dict(zip(map(id, held), zip(*self._best(np.stack([n.hist for n in held])), strict=True), strict=True)) if held else {}
        for node in nodes:
            if node.hist is None or spec.depth is not None and node.depth >= spec.depth and node.feature == LEAF:
                if spec.kind == "gradient" and node.feature == LEAF and node.stats[2] > 0:
                    node.value += self._step(node.stats)
                    node.hist = None
                continue
            h, allowed = node.hist, tree.features
            if spec.leaf_subset:
                rng = np.random.default_rng([spec.seed, member, node.serial])
                allowed = set(rng.choice(sorted(allowed), min(spec.leaf_subset, len(allowed)), replace=False).tolist())
            gains, n = self._gains(*best[id(node)], allowed), self._size(h)
            if node.feature != LEAF:
                # an inner node of a revisiting tree: replace a split that is no longer the best one
                now = {g[1]: g[0] for g in gains}.get(node.feature, 0.0)
                if not gains or gains[0][1] == node.feature or gains[0][0] - now <= self._bound(n):
                    continue
                self._collapse(node)
                node.hist = h
            why = self._may_split(gains, n) if gains else None
            if why is None:
                if spec.kind == "gradient":
                    if node.stats[2] > 0:
                        node.value += self._step(node.stats)
                    node.hist = None
                continue
            close = [g for g in gains[1:3] if 1 - g[0] / gains[0][0] <= self._bound(n)] if why == "tie" else []
            close = close[: spec.options - tree.options]
            if close:
                tree.options += len(close)
                node.feature, node.children = OPTION, []
                for _, f, cut in [gains[0], *close]:
                    way = tree.leaf(node.depth, node.stats, node.value, node.centre)
                    self._divide(tree, way, h, f, cut)
                    node.children.append(way)
            else:
                self._divide(tree, node, h, *gains[0][1:])
            if not spec.revisit:
                node.hist = None

    def _choose(self, tree: Tree, trees: int) -> None:
        """The leaves with most errors to lose learn on; the others drop their histograms until they are among these again."""
        leaves = tree.leaves()
        room = max(1, min(self.spec.active, MAX_CELLS // (trees * len(self.features) * BINS * self.outputs)))
        if len(leaves) > room:
            def promise(node: Node) -> float:
                s = node.stats
                if self.spec.kind == "class":
                    return s.sum() - s.max()
                return s[2] - s[1] ** 2 / s[0] if s[0] > 0 else 0.0

            leaves = sorted(leaves, key=lambda n: (-promise(n), n.serial))
        for i, node in enumerate(leaves):
            node.learns = i < room
            if not node.learns:
                node.hist = None

    # ------------------------------------------------------------ drift of members

    def _restart(self, cells: Cells) -> None:
        spec = self.spec
        if spec.vote == "majority":
            self._turn_over(cells.get(-1, VOTE, (2 + self.outputs,)), cells)
        if not spec.reset:
            return
        drifted = set()
        for i in range(len(self.trees)):
            error = cells.get(i, TREE_ERROR, (6,), top=3)[:4]
            if spec.reset == "member" and self.warning[i].add(*error):
                self.background[i] = self.new_tree()
                self.background[i].features = self.trees[i].features
                self.warning[i] = BlockAdwin(spec.warn)
            if self.adwin[i].add(*error):
                drifted.add(i)
        if drifted and spec.reset == "worst":
            drifted = {int(np.argmax([t.errors[1] / t.errors[0] if t.errors[0] else 0.0 for t in self.trees]))}
        for i in drifted:
            self.trees[i] = self.background[i] or self.new_tree()
            self.background[i] = None
            self.adwin[i], self.warning[i] = BlockAdwin(spec.drift), BlockAdwin(spec.warn)
            self.right[i] = self.wrong[i] = 0.0

    def _turn_over(self, vote: np.ndarray, cells: Cells) -> None:
        """Members of a majority vote come and go."""
        if vote[0] <= 0:
            return
        wrong = np.array([cells.get(i, TREE_ERROR, (6,))[1] for i in range(len(self.trees))])
        weight, stays, add = majority_weights(self.weight, wrong, vote[0], vote[1], 1 - vote[2:].max() / vote[0])
        keep = sorted(np.flatnonzero(stays), key=lambda i: -weight[i])[: self.spec.most - add]
        keep = sorted(keep)
        self.trees, self.weight = [self.trees[i] for i in keep], weight[keep]
        if add:
            self.trees.append(self.new_tree())
            self.weight = np.append(self.weight, 1.0)
        n = len(self.trees)
        self.background = [None] * n
        self.right, self.wrong = np.zeros(n), np.zeros(n)
