"""Row-by-row models for fleets of streams: exact test-then-train, parallel over the streams.

A model that changes with every row is serial inside one stream. A stream is therefore replayed in rounds of
at most ``chunk_rows`` rows; the state of each key goes from round to round as a small table. No task ever
holds more than one chunk of one stream, however long a hot stream is. For one huge stream use the block
models instead, which are parallel inside the stream.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.stream import Stream, parallelism
from tidemark.session import written

CHUNK_ROWS = 1_000_000
#: Rows of one group of keys, on average.
BUCKET_ROWS = 200_000
#: A stream without keys is replayed up to this length, in chunks; it runs on one core.
KEYLESS_ROWS = 1_000_000


class RunningScale:
    """Mean and variance so far; scaling uses the current values."""

    def __init__(self, n: int) -> None:
        self.n, self.mean, self.m2 = 0, np.zeros(n), np.zeros(n)

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        gap = x - self.mean
        self.mean = self.mean + gap / self.n
        self.m2 = self.m2 + gap * (x - self.mean)

    def scale(self, x: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros_like(x)
        var = self.m2 / self.n
        return np.where(var > 0, (x - self.mean) / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)


class OnlineLinear:
    """Per-row linear model. ``loss``: squared, log, pa1, pa2, pa_class or alma."""

    def __init__(self, n: int, loss: str = "squared", rate: float = 0.01, l1: float = 0.0, l2: float = 0.0, c: float = 1.0, eps: float = 0.1, scaled: bool = True) -> None:
        self.loss, self.rate, self.l1, self.l2, self.c, self.eps = loss, rate, l1, l2, c, eps
        self.scaler = RunningScale(n) if scaled else None
        self.w, self.b, self.u, self.q, self.k = np.zeros(n), 0.0, 0.0, np.zeros(n), 1

    def raw(self, x: np.ndarray) -> float:
        return float(self.w @ x) + self.b

    def predict(self, x: np.ndarray) -> float:
        score = self.raw(self.scaler.scale(x) if self.scaler else x)
        return float(score > 0) if self.loss in ("log", "pa_class", "alma") else score

    def learn(self, x: np.ndarray, y: float) -> None:
        if self.scaler:
            self.scaler.add(x)
            x = self.scaler.scale(x)
        p, sign = self.raw(x), 2 * y - 1
        if self.loss in ("squared", "log"):
            g = 2 * (p - y) if self.loss == "squared" else 1 / (1 + math.exp(-max(min(p, 500.0), -500.0))) - y
            g = max(min(g, 1e12), -1e12)
            self.w = self.w - self.rate * (g * x + self.l2 * self.w)
            self.b -= self.rate * g
            if self.l1:
                self._penalty()
            return
        norm = float(x @ x)
        if self.loss == "alma":
            alpha = 0.9
            size = math.sqrt(norm) or 1.0
            if sign * p <= (1 - alpha) / alpha / math.sqrt(self.k) * size:
                self.w = self.w + math.sqrt(2.0) / math.sqrt(self.k) * sign * x / size
                self.w = self.w / max(1.0, math.sqrt(float(self.w @ self.w)))
                self.k += 1
            return
        if self.loss == "pa_class":
            miss, way = max(0.0, 1 - sign * p), sign
        else:
            miss, way = max(0.0, abs(y - p) - self.eps), math.copysign(1.0, y - p)
        if miss > 0:
            tau = miss / (norm + 1 / (2 * self.c)) if self.loss == "pa2" else min(self.c, miss / norm) if norm else 0.0
            self.w = self.w + tau * way * x

    def _penalty(self) -> None:
        self.u += self.rate * self.l1
        old = self.w.copy()
        low, high = np.maximum(0.0, old - (self.u + self.q)), np.minimum(0.0, old + (self.u - self.q))
        self.w = np.where(old > 0, low, np.where(old < 0, high, 0.0))
        self.q = self.q + self.w - old

    def dump(self) -> str:
        s = self.scaler
        return json.dumps(
            {
                "w": self.w.tolist(), "b": self.b, "u": self.u, "q": self.q.tolist(), "k": self.k,
                "s": [s.n, s.mean.tolist(), s.m2.tolist()] if s else None,
            }
        )

    def load(self, text: str) -> "OnlineLinear":
        d = json.loads(text)
        self.w, self.b, self.u, self.q, self.k = np.array(d["w"]), d["b"], d["u"], np.array(d["q"]), d["k"]
        if d["s"]:
            self.scaler.n, self.scaler.mean, self.scaler.m2 = d["s"][0], np.array(d["s"][1]), np.array(d["s"][2])
        return self


def replay_rows(model, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Predict, then learn, row by row."""
    out = np.empty(len(y))
    for i in range(len(y)):
        out[i] = model.predict(x[i])
        if not math.isnan(y[i]):
            model.learn(x[i], y[i])  # a row without a target is predicted only
    return out


class Fleet:
    """The same linear model for many keys, one row of every array for each key, learning in lock step."""

    def __init__(self, model: OnlineLinear, n: int, count: int) -> None:
        self.like, self.scaled = model, model.scaler is not None
        self.w, self.q, self.mean, self.m2 = (np.zeros((count, n)) for _ in range(4))
        self.b, self.u, self.seen = (np.zeros(count) for _ in range(3))
        self.k = np.ones(count)

    def load(self, i: int, text: str) -> None:
        d = json.loads(text)
        self.w[i], self.b[i], self.u[i], self.q[i], self.k[i] = d["w"], d["b"], d["u"], d["q"], d["k"]
        if d["s"]:
            self.seen[i], self.mean[i], self.m2[i] = d["s"]

    def dump(self, i: int) -> str:
        scaler = [int(self.seen[i]), self.mean[i].tolist(), self.m2[i].tolist()] if self.scaled else None
        return json.dumps({"w": self.w[i].tolist(), "b": self.b[i], "u": self.u[i], "q": self.q[i].tolist(), "k": int(self.k[i]), "s": scaler})

    def _scale(self, i, x: np.ndarray) -> np.ndarray:
        if not self.scaled:
            return x
        var = self.m2[i] / np.maximum(self.seen[i], 1)[:, None]
        return np.where(var > 0, (x - self.mean[i]) / np.sqrt(np.where(var > 0, var, 1.0)), 0.0)

    def _raw(self, i, x: np.ndarray) -> np.ndarray:
        return (self.w[i] * x).sum(1) + self.b[i]

    def predict(self, i, x: np.ndarray) -> np.ndarray:
        score = self._raw(i, self._scale(i, x))
        return (score > 0).astype(float) if self.like.loss in ("log", "pa_class", "alma") else score

    def learn(self, i: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """One row for each of the keys ``i``."""
        m = self.like
        if self.scaled:
            self.seen[i] += 1
            gap = x - self.mean[i]
            self.mean[i] += gap / self.seen[i][:, None]
            self.m2[i] += gap * (x - self.mean[i])
            x = self._scale(i, x)
        p, sign = self._raw(i, x), 2 * y - 1
        if m.loss in ("squared", "log"):
            g = 2 * (p - y) if m.loss == "squared" else 1 / (1 + np.exp(-np.clip(p, -500.0, 500.0))) - y
            g = np.clip(g, -1e12, 1e12)
            self.w[i] -= m.rate * (g[:, None] * x + m.l2 * self.w[i])
            self.b[i] -= m.rate * g
            if m.l1:
                self.u[i] += m.rate * m.l1
                u, old = self.u[i][:, None], self.w[i]
                low, high = np.maximum(0.0, old - (u + self.q[i])), np.minimum(0.0, old + (u - self.q[i]))
                self.w[i] = np.where(old > 0, low, np.where(old < 0, high, 0.0))
                self.q[i] += self.w[i] - old
            return
        norm = (x * x).sum(1)
        if m.loss == "alma":
            alpha, root = 0.9, np.sqrt(self.k[i])
            size = np.where(norm > 0, np.sqrt(norm), 1.0)
            hit = sign * p <= (1 - alpha) / alpha / root * size
            new = self.w[i] + (math.sqrt(2.0) / root * sign / size)[:, None] * x
            new /= np.maximum(1.0, np.sqrt((new * new).sum(1)))[:, None]
            self.w[i] = np.where(hit[:, None], new, self.w[i])
            self.k[i] += hit
            return
        if m.loss == "pa_class":
            miss, way = np.maximum(0.0, 1 - sign * p), sign
        else:
            miss, way = np.maximum(0.0, np.abs(y - p) - m.eps), np.copysign(1.0, y - p)
        if m.loss == "pa2":
            tau = miss / (norm + 1 / (2 * m.c))
        else:
            tau = np.where(norm > 0, np.minimum(m.c, miss / np.where(norm > 0, norm, 1.0)), 0.0)
        self.w[i] += (tau * way)[:, None] * x


def replay_fleet(fleet: Fleet, x: np.ndarray, y: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Predict, then learn, all keys in lock step; key i has ``lengths[i]`` rows from ``starts[i]``, and lengths fall."""
    out = np.empty(len(y))
    for t in range(int(lengths[0]) if len(lengths) else 0):
        i = np.arange(np.searchsorted(-lengths, -t, "left"))  # keys with more than t rows
        at = starts[i] + t
        out[at] = fleet.predict(i, x[at])
        known = ~np.isnan(y[at])
        fleet.learn(i[known], x[at[known]], y[at[known]])
    return out


def replay(stream: Stream, models: dict[str, Callable], features: list[str], target: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(keys, step, target, one prediction column per model); ``models`` maps names to ``f(n_features)``.

    Missing features count as 0. A stream without keys is one group, so only a short one is taken."""
    if not stream.by and stream.n > KEYLESS_ROWS:
        raise ValueError(f"a stream of more than {KEYLESS_ROWS} rows without keys can't be spread: use a block model")
    by = list(stream.by) or ["_one"]
    rows = stream.df if stream.by else stream.df.withColumn("_one", F.lit(0))
    rows = rows.select(*by, "step", F.col(target).cast("double").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    types = dict(rows.dtypes)
    keys = ", ".join(f"{k} {types[k]}" for k in by)
    schema = f"{keys}, step long, _y double, {', '.join(f'`{m}` double' for m in models)}, _state string"
    names = list(models)
    # keys by the bucket: many in one group, so that they are replayed together
    buckets = max(parallelism(rows, 4), math.ceil(stream.n / BUCKET_ROWS)) if stream.by else 1
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("_bucket")
    rows = rows.select("*", bucket).repartition(parallelism(rows, 4), "_bucket")

    def run(rows_pdf: pd.DataFrame, state_pdf: pd.DataFrame | None) -> pd.DataFrame:
        if rows_pdf.empty:
            return pd.DataFrame({c.split()[0].strip("`"): [] for c in schema.split(", ")})
        rows_pdf = rows_pdf.sort_values([*by, "step"], kind="stable")
        code = rows_pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        lengths = np.diff(np.append(starts, len(code)))
        order = np.argsort(-lengths, kind="stable")  # long ones first
        starts, lengths = starts[order], lengths[order]
        x, y = rows_pdf[features].fillna(0.0).to_numpy(float), rows_pdf["_y"].to_numpy(float)
        keys_of = list(rows_pdf[by].iloc[starts].itertuples(index=False, name=None))
        old = {}
        if state_pdf is not None and len(state_pdf):
            old = dict(zip(state_pdf[by].itertuples(index=False, name=None), map(json.loads, state_pdf["_state"]), strict=True))
        out = rows_pdf[[*by, "step", "_y"]].copy()
        new: list[dict] = [{} for _ in starts]
        for m in names:
            model = models[m](len(features))
            if type(model) is OnlineLinear:
                fleet = Fleet(model, len(features), len(starts))
                for i, key in enumerate(keys_of):
                    if m in old.get(key, {}):
                        fleet.load(i, old[key][m])
                out[m] = replay_fleet(fleet, x, y, starts, lengths)
                if keep:
                    for i, d in enumerate(new):
                        d[m] = fleet.dump(i)
                continue
            done = np.empty(len(y))
            for i, (s, n) in enumerate(zip(starts, lengths, strict=True)):  # a model of the user's own: key by key
                model = models[m](len(features))
                if m in old.get(keys_of[i], {}):
                    model.load(old[keys_of[i]][m])
                done[s : s + n] = replay_rows(model, x[s : s + n], y[s : s + n])
                new[i][m] = model.dump()
            out[m] = done
        state = np.full(len(out), None, dtype=object)
        if keep:
            state[starts + lengths - 1] = [json.dumps(d) for d in new]
        out["_state"] = state
        return out

    longest = stream.n if not stream.by else rows.agg(F.max("step")).collect()[0][0] or 0
    rounds = max(1, math.ceil(longest / chunk_rows))
    keep = rounds > 1
    parts, state = [], None
    if keep:  # cut once; each round reads its own part
        rows = written(rows.withColumn("_round", F.floor((F.col("step") - 1) / chunk_rows)), "replay-rows")
    for r in range(rounds):
        mine = rows.filter(F.col("_round") == r).drop("_round") if keep else rows
        if state is None:
            done = mine.groupBy("_bucket").applyInPandas(lambda pdf: run(pdf, None), schema)
        else:
            done = mine.groupBy("_bucket").cogroup(state.groupBy("_bucket")).applyInPandas(run, schema)
        if rounds > 1:
            done = written(done, "replay")
            state = done.filter(F.col("_state").isNotNull()).select(*by, "_state", bucket)
        parts.append(done)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("_state", *(["_one"] if not stream.by else []))
