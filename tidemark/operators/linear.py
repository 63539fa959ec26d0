"""Linear models in blocks: one gradient (or step) aggregate per block, predictions by expression.

All of them run in the same job per block. Their per-row counterparts for fleets of short streams are in
``replay``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import Blocks


def block_scaled(blocks: Blocks, features: list[str], rows: DataFrame | None = None) -> DataFrame:
    """Add ``z_<f>`` scaled by the blocks before (for predictions) and ``l_<f>`` by the blocks so far (for learning).

    The statistics of all blocks add up, so one aggregation serves the whole stream.
    """
    rows = blocks.stream.df if rows is None else rows
    centre = blocks.stream.centre
    aggs = []
    for f in features:
        v = F.col(f).cast("double") - F.lit(float(centre.get(f, 0.0)))
        aggs += [F.count(v).alias(f"n_{f}"), F.sum(v).alias(f"s_{f}"), F.sum(v * v).alias(f"q_{f}")]
    per_block = {r["b"]: r for r in rows.groupBy(blocks.number().alias("b")).agg(*aggs).collect()}
    n, s, q = (np.zeros(len(features)) for _ in range(3))
    stats = [([0.0] * len(features), [0.0] * len(features))]
    for b in range(1, blocks.used + 1):
        r = per_block[b]
        n += [r[f"n_{f}"] for f in features]
        s += [r[f"s_{f}"] or 0.0 for f in features]
        q += [r[f"q_{f}"] or 0.0 for f in features]
        seen = np.maximum(n, 1.0)
        var = np.maximum(q / seen - (s / seen) ** 2, 0.0)
        mean = s / seen + [centre.get(f, 0.0) for f in features]
        stats.append((mean.tolist(), np.sqrt(var).tolist()))
    states = [{"zm": stats[b][0], "zs": stats[b][1], "lm": stats[b + 1][0], "ls": stats[b + 1][1]} for b in range(blocks.used)]
    out = blocks.with_state(states, "zm array<double>, zs array<double>, lm array<double>, ls array<double>", rows)
    cols = {}
    for i, f in enumerate(features):
        for k in "zl":
            spread = F.col(f"{k}s")[i]
            scaled = F.when(spread > 0, (F.col(f) - F.col(f"{k}m")[i]) / F.nullif(spread, F.lit(0.0)))
            cols[f"{k}_{f}"] = F.coalesce(scaled, F.lit(0.0))  # a missing value counts as the mean
    return out.withColumns(cols).drop("zm", "zs", "lm", "ls", "block")


def _total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


@dataclass
class LinearBlock:
    """Squared-loss or log-loss gradient descent, and the passive-aggressive and margin families.

    ``loss``: squared, log, pa1, pa2 (regression), pa_class, alma, one_class. ``target`` is the learning
    target (0/1 for classes). One step per block, with the mean gradient (or mean update) of its rows.
    """

    name: str
    features: list[str]
    target: Column
    loss: str = "squared"
    rate: float = 0.1
    l1: float = 0.0
    l2: float = 0.0
    c: float = 1.0
    eps: float = 0.1
    nu: float = 0.1
    scaled: bool = True
    schema = "w array<double>; b double"

    def empty(self):
        return {"w": np.zeros(len(self.features)), "b": 0.0, "k": 1, "u": 0.0, "q": np.zeros(len(self.features))}

    def columns(self, state) -> dict:
        return {"w": [float(v) for v in state["w"]], "b": float(state["b"])}

    def _x(self, kind: str) -> list[Column]:
        return [F.col(f"{kind}_{f}" if self.scaled else f) for f in self.features]

    def _score(self, x: list[Column], w: list[Column], b: Column) -> Column:
        return _total([xi * wi for xi, wi in zip(x, w)]) + b

    def predict(self) -> Column:
        x = self._x("z")
        score = self._score(x, [F.col(f"{self.name}__w")[i] for i in range(len(x))], F.col(f"{self.name}__b"))
        if self.loss in ("log", "pa_class", "alma"):
            return (score > 0).cast("double")
        if self.loss == "one_class":
            return -score  # distance to the wrong side of the boundary
        return score

    def totals(self, state) -> dict[str, Column]:
        x = self._x("l")
        y = self.target.cast("double")
        score = self._score(x, [F.lit(float(v)) for v in state["w"]], F.lit(float(state["b"])))
        norm = _total([xi * xi for xi in x]) + 1.0
        sign = 2 * y - 1
        if self.loss == "squared":
            step = 2 * (score - y)
        elif self.loss == "log":
            step = 1.0 / (1.0 + F.exp(-score)) - y
        elif self.loss in ("pa1", "pa2"):
            miss = F.greatest(F.lit(0.0), F.abs(y - score) - self.eps)
            tau = F.least(F.lit(self.c), miss / norm) if self.loss == "pa1" else miss / (norm + 1.0 / (2 * self.c))
            step = tau * F.signum(y - score)
        elif self.loss == "pa_class":
            step = F.least(F.lit(self.c), F.greatest(F.lit(0.0), 1 - sign * score) / norm) * sign
        elif self.loss == "alma":
            alpha = 0.9
            margin = (1 - alpha) / alpha / math.sqrt(state["k"])
            step = F.when(sign * score <= margin * F.sqrt(norm), sign).otherwise(0.0) / F.sqrt(norm)
        else:  # one_class: hinge below the offset
            step = F.when(score < 0, 1.0).otherwise(0.0)
        if self.loss != "one_class":
            step = F.when(y.isNotNull(), step)  # rows without a target take no part in the mean
        out = {f"g{i}": F.avg(step * xi) for i, xi in enumerate(x)}
        return {**out, "gb": F.avg(step)}

    def learn(self, state, sums):
        g = np.array([sums[f"g{i}"] or 0.0 for i in range(len(self.features))])
        gb = sums["gb"] or 0.0
        w, b, k = state["w"].copy(), state["b"], state["k"]
        u, q = state["u"], state["q"].copy()
        if self.loss in ("squared", "log"):
            w -= self.rate * (g + self.l2 * w)
            b -= self.rate * gb
            if self.l1:
                # cumulative penalty (Tsuruoka, Tsujii and Ananiadou 2009)
                u += self.rate * self.l1
                for i in range(len(w)):
                    old = w[i]
                    w[i] = max(0.0, old - (u + q[i])) if old > 0 else min(0.0, old + (u - q[i])) if old < 0 else 0.0
                    q[i] += w[i] - old
        elif self.loss == "one_class":
            w = w - self.rate * (w - g / self.nu)
            b -= self.rate * (1.0 - gb / self.nu)  # b is minus the offset
        elif self.loss == "alma":
            step = math.sqrt(2.0) / math.sqrt(k)
            w, b = w + step * g, b + step * gb
            size = math.sqrt(float(w @ w) + b * b)
            if size > 1.0:
                w, b = w / size, b / size
        else:
            w, b = w + g, b + gb
        return {"w": w, "b": b, "k": k + 1, "u": u, "q": q}


@dataclass
class SoftmaxBlock:
    """Multinomial logistic regression; predicts the class index."""

    name: str
    features: list[str]
    target: Column  # class index
    classes: int
    rate: float = 0.5
    schema = "w array<array<double>>"

    def empty(self):
        return np.zeros((self.classes, len(self.features) + 1))

    def columns(self, state) -> dict:
        return {"w": state.tolist()}

    def _scores(self, kind: str, w) -> list[Column]:
        x = [*[F.col(f"{kind}_{f}") for f in self.features], F.lit(1.0)]
        return [_total([xi * w(c, i) for i, xi in enumerate(x)]) for c in range(self.classes)]

    def predict(self) -> Column:
        scores = self._scores("z", lambda c, i: F.col(f"{self.name}__w")[c][i])
        top = F.greatest(*scores)
        return F.coalesce(*[F.when(s == top, F.lit(float(c))) for c, s in enumerate(scores)])

    def totals(self, state) -> dict[str, Column]:
        scores = self._scores("l", lambda c, i: F.lit(float(state[c, i])))
        top = F.greatest(*scores)
        odds = [F.exp(s - top) for s in scores]
        x = [*[F.col(f"l_{f}") for f in self.features], F.lit(1.0)]
        out = {}
        for c in range(self.classes):
            miss = odds[c] / _total(odds) - (self.target == c).cast("double")
            out |= {f"g{c}_{i}": F.avg(miss * xi) for i, xi in enumerate(x)}
        return out

    def learn(self, state, sums):
        g = np.array([[sums[f"g{c}_{i}"] or 0.0 for i in range(state.shape[1])] for c in range(self.classes)])
        return state - self.rate * g


@dataclass
class MlpBlock:
    """One hidden ReLU layer trained by backpropagation on the block mean; predicts the target."""

    name: str
    features: list[str]
    target: Column
    hidden: int = 5
    rate: float = 1e-2
    scale: float = 1.0  # target is learned divided by this
    seed: int = 42
    schema = "w1 array<array<double>>; w2 array<double>"

    def empty(self):
        rng = np.random.default_rng(self.seed)
        return {"w1": rng.normal(0, 0.5, (self.hidden, len(self.features) + 1)), "w2": rng.normal(0, 0.5, self.hidden + 1)}

    def columns(self, state) -> dict:
        return {"w1": state["w1"].tolist(), "w2": state["w2"].tolist()}

    def _forward(self, kind, w1, w2):
        x = [*[F.col(f"{kind}_{f}") for f in self.features], F.lit(1.0)]
        pre = [_total([xi * w1(h, i) for i, xi in enumerate(x)]) for h in range(self.hidden)]
        act = [F.greatest(F.lit(0.0), p) for p in pre]
        return x, pre, act, _total([a * w2(h) for h, a in enumerate([*act, F.lit(1.0)])])

    def predict(self) -> Column:
        *_, out = self._forward("z", lambda h, i: F.col(f"{self.name}__w1")[h][i], lambda h: F.col(f"{self.name}__w2")[h])
        return out * self.scale

    def totals(self, state) -> dict[str, Column]:
        x, pre, act, out = self._forward("l", lambda h, i: F.lit(float(state["w1"][h, i])), lambda h: F.lit(float(state["w2"][h])))
        miss = 2 * (out - self.target.cast("double") / self.scale)
        sums = {f"o{h}": F.avg(miss * a) for h, a in enumerate([*act, F.lit(1.0)])}
        for h in range(self.hidden):
            back = F.when(pre[h] > 0, miss * float(state["w2"][h])).otherwise(0.0)
            sums |= {f"h{h}_{i}": F.avg(back * xi) for i, xi in enumerate(x)}
        return sums

    def learn(self, state, sums):
        g2 = np.array([sums[f"o{h}"] or 0.0 for h in range(self.hidden + 1)])
        g1 = np.array([[sums[f"h{h}_{i}"] or 0.0 for i in range(len(self.features) + 1)] for h in range(self.hidden)])
        return {"w1": state["w1"] - self.rate * g1, "w2": state["w2"] - self.rate * g2}


# ---------------------------------------------------------------- statistics that add up


def product_sums(blocks: Blocks, columns: list[str], rows: DataFrame | None = None) -> DataFrame:
    """(block, n, sums of all pairwise products) of the blocks; the constant 1 is the first column.

    Rows with a missing value in any of the columns are left out, so that all sums are over the same rows.
    """
    rows = (blocks.stream.df if rows is None else rows).dropna(subset=columns)
    names = ["1", *columns]
    value = {"1": F.lit(1.0), **{c: F.col(c).cast("double") for c in columns}}
    aggs = [F.sum(value[a] * value[b]).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(blocks.number().alias("block")).agg(*aggs)


def _moment_matrices(blocks: Blocks, columns: list[str], rows: DataFrame | None = None) -> list[np.ndarray]:
    """Cumulative moment matrix before each block; as many small matrices as blocks."""
    names = ["1", *columns]
    total = np.zeros((len(names), len(names)))
    out = [total.copy()]
    for r in product_sums(blocks, columns, rows).orderBy("block").collect():
        for i, a in enumerate(names):
            for j, b in enumerate(names[i:], i):
                total[i, j] += r[f"{a}*{b}"] or 0.0
                total[j, i] = total[i, j]
        out.append(total.copy())
    return out[: blocks.used]


def normal_equations(blocks: Blocks, features: list[str], target: str, ridge: float = 1e-6, name: str = "least_squares") -> DataFrame:
    """Least squares on all blocks before, from prefix sums of products: one job for all blocks."""
    states = []
    for m in _moment_matrices(blocks, [*features, target]):
        if m[0, 0] == 0:
            states.append({"w": [0.0] * (len(features) + 1)})
            continue
        k = len(features) + 1
        scale = np.sqrt(np.maximum(np.diag(m)[:k], 1e-300))
        a = m[:k, :k] / np.outer(scale, scale) + ridge * np.eye(k)
        states.append({"w": (np.linalg.solve(a, m[:k, k] / scale) / scale).tolist()})
    out = blocks.with_state(states, "w array<double>")
    pred = _total([F.col("w")[0], *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.col("w")[i + 1] for i, f in enumerate(features)]])
    return out.withColumn(name, pred).drop("w", "block")


def linear_autoencoder(blocks: Blocks, features: list[str], hidden: int = 1, name: str = "autoencoder") -> DataFrame:
    """Reconstruction error of the leading components (Baldi and Hornik 1989) of the blocks before."""
    states = []
    for m in _moment_matrices(blocks, features):
        n = m[0, 0]
        if n == 0:
            states.append({"m": [0.0] * len(features), "s": [1.0] * len(features), "v": [[0.0] * len(features)] * hidden})
            continue
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        _, vectors = np.linalg.eigh(cov / np.outer(spread, spread))
        states.append({"m": mean.tolist(), "s": spread.tolist(), "v": vectors[:, ::-1].T[:hidden].tolist()})
    out = blocks.with_state(states, "m array<double>, s array<double>, v array<array<double>>")
    z = [(F.col(f).cast("double") - F.col("m")[i]) / F.col("s")[i] for i, f in enumerate(features)]
    codes = [_total([zi * F.col("v")[h][i] for i, zi in enumerate(z)]) for h in range(hidden)]
    back = [_total([codes[h] * F.col("v")[h][i] for h in range(hidden)]) for i in range(len(features))]
    error = _total([(zi - bi) * (zi - bi) for zi, bi in zip(z, back)])
    return out.withColumn(name, F.when(F.col("block") > 1, error).otherwise(0.0)).drop("m", "s", "v", "block")
