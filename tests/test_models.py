"""Invariants of the models: no look-ahead, repeatable, better than a baseline where there is a signal."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ensembles, isolation, linear, mondrian, neighbours, rules
from tidemark.operators.drift import BlockAdwin
from tidemark.operators.linear import LinearBlock, MlpBlock, SoftmaxBlock, block_scaled
from tidemark.operators.replay import OnlineLinear, replay, replay_rows
from tidemark.operators.trees import Forest, TreeSpec
from tidemark.plans import spans
from tidemark.plans.blocks import Blocks, run_blocks
from tidemark.plans.stream import prepare

N, COUNT = 1200, 4
FEATS = ["a", "b", "c"]


def rows_of(changed: bool):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, (N, 3))
    y = np.where(x[:, 0] > 0.5, 10.0, 0.0) + 5 * x[:, 1]
    cls = (x[:, 0] > 0.5).astype(int) + (x[:, 1] > 0.7).astype(int)
    if changed:  # everything after block 3 of 4 is different
        cut = N * 3 // COUNT
        x[cut:], y[cut:], cls[cut:] = x[cut:] * -3 + 1, y[cut:] * 7, 2 - cls[cut:]
    return [(i, *map(float, x[i]), float(y[i]), int(cls[i])) for i in range(N)]


@pytest.fixture(scope="module")
def streams(spark):
    out = []
    for changed in (False, True):
        df = spark.createDataFrame(rows_of(changed), "id int, a double, b double, c double, y double, cls int")
        out.append((prepare(df, ("id",), "y", tuple(FEATS)), prepare(df, ("id",), "cls", tuple(FEATS))))
    return out


def forest(kind, **opts):
    if kind == "class":
        return lambda reg, cls: Forest(Blocks(cls, COUNT), TreeSpec("p", **opts), FEATS, F.col("cls"), 3).run()
    return lambda reg, cls: Forest(Blocks(reg, COUNT), TreeSpec("p", kind=kind, **opts), FEATS, F.col("y")).run()


def linear_models(reg, cls):
    blocks = Blocks(reg, COUNT)
    models = [
        LinearBlock("sq", FEATS, F.col("y"), rate=0.3), LinearBlock("pa1", FEATS, F.col("y"), loss="pa1"),
        LinearBlock("pa2", FEATS, F.col("y"), loss="pa2"), LinearBlock("one", FEATS, F.col("y"), loss="one_class"),
        LinearBlock("alma", FEATS, (F.col("y") > 5).cast("int"), loss="alma"),
        MlpBlock("mlp", FEATS, F.col("y"), scale=10.0, rate=0.05), SoftmaxBlock("soft", FEATS, F.col("cls"), 3),
    ]
    out = run_blocks(blocks, models, block_scaled(blocks, FEATS))
    return out.withColumn("p", F.sqrt(sum((F.col(m.name) * F.col(m.name) for m in models[1:]), F.col("sq") * F.col("sq"))))


MODELS = {
    "tree": forest("class", delta=0.05), "efdt": forest("class", delta=0.05, revisit=True), "hat": forest("class", delta=0.05, on_drift="alternate"),
    "arf": forest("class", members=4, rate=6.0, leaf_subset=2, reset="member", vote="accuracy"),
    "leveraging": forest("class", members=4, rate=6.0, reset="worst"), "oza": forest("class", delta=0.05, members=3, boost="oza", vote="log_odds"),
    "reg_tree": forest("reg"), "gradient": forest("gradient", members=3, shrink=0.8),
    "mondrian": lambda reg, cls: mondrian.mondrian_forest(Blocks(cls, COUNT), FEATS, F.col("cls"), 3, n_trees=4, name="p"),
    "mondrian_reg": lambda reg, cls: mondrian.mondrian_forest(Blocks(reg, COUNT), FEATS, F.col("y"), 0, n_trees=4, name="p"),
    "rules": lambda reg, cls: rules.model_rules(Blocks(reg, COUNT), FEATS, F.col("y"), name="p"),
    "leaves": lambda reg, cls: ensembles.NearestLeaves(Blocks(reg, COUNT), TreeSpec("p", kind="reg", members=3, rate=6.0), FEATS, F.col("y")).run(),
    "shrubs": lambda reg, cls: ensembles.Shrubs(Blocks(cls, COUNT), TreeSpec("p", members=3, depth=3), FEATS, F.col("cls"), 3).run(),
    "stacking": lambda reg, cls: ensembles.stacking(Blocks(cls, COUNT), FEATS, [0, 1, 2], F.col("cls"), name="p"),
    "sam": lambda reg, cls: ensembles.two_memories(Blocks(cls, COUNT), FEATS, (20, 50), name="p"),
    "linear": linear_models,
    "normal": lambda reg, cls: linear.normal_equations(Blocks(reg, COUNT), FEATS, "y", name="p"),
    "pca": lambda reg, cls: linear.linear_autoencoder(Blocks(reg, COUNT), FEATS, name="p"),
    **{k: (lambda reg, cls, k=k: isolation.tree_scores(Blocks(reg, COUNT), FEATS, k, name="p")) for k in ("path", "histogram", "displacement")},
}
_first: dict = {}


def scores(name, pair):
    return {r["step"]: r["p"] for r in MODELS[name](*pair).select("step", "p").collect()}


def close(a, b):
    return a == b or (a is not None and b is not None and a == pytest.approx(b, rel=1e-9, abs=1e-9))


@pytest.mark.parametrize("name", MODELS)
def test_no_look_ahead(streams, name):
    """Rows of block 3 and before do not notice what comes later, although all rows are scored in one job."""
    plain, changed = scores(name, streams[0]), scores(name, streams[1])
    _first[name] = plain
    assert len(plain) == N
    upto = N * 3 // COUNT
    assert all(close(plain[s], changed[s]) for s in range(1, upto + 1))


@pytest.mark.parametrize("name", ["arf", "rules", "mondrian", "path"])
def test_partitioning_does_not_matter(spark, streams, name):
    df = spark.createDataFrame(rows_of(False), "id int, a double, b double, c double, y double, cls int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        pair = (prepare(df.coalesce(1), ("id",), "y", tuple(FEATS)), prepare(df.coalesce(1), ("id",), "cls", tuple(FEATS)))
        again = scores(name, pair)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    first = _first.get(name) or scores(name, streams[0])
    assert all(close(first[s], again[s]) for s in first)


def test_models_find_the_signal(streams):
    truth = {i + 1: r for i, r in enumerate(rows_of(False))}
    late = range(N // COUNT + 1, N + 1)
    majority = max(sum(truth[s][5] == c for s in late) for c in range(3)) / len(late)
    spread = np.mean([abs(truth[s][4] - np.mean([truth[t][4] for t in late])) for s in late])
    for name in ("tree", "efdt", "hat", "arf", "leveraging", "oza", "mondrian", "shrubs", "stacking", "sam"):
        got = _first.get(name) or scores(name, streams[0])
        assert np.mean([got[s] == truth[s][5] for s in late]) > majority, name
    for name in ("reg_tree", "gradient", "mondrian_reg", "rules", "leaves", "normal"):
        got = _first.get(name) or scores(name, streams[0])
        assert np.mean([abs(got[s] - truth[s][4]) for s in late]) < spread, name


def test_neighbours_equal_brute_force(streams, monkeypatch):
    monkeypatch.setattr(spans, "SPAN_ROWS", 100)
    x = np.array([r[1:4] for r in rows_of(False)])
    out = neighbours.nearest(streams[0][0], FEATS, 3, 40).collect()
    assert len(out) == N
    for r in out:
        i = r["step"] - 1
        cand = np.arange(max(0, i - 40), i)
        dist = ((x[cand] - x[i]) ** 2).sum(axis=1)
        want = [int(cand[j]) + 1 for j in np.argsort(dist, kind="stable")[:3]]
        assert [n["step"] for n in r["neighbours"]] == want


def test_oversampling_adds_rows_between_neighbours(streams):
    st = streams[0][1]
    out = ensembles.oversampled(st, FEATS, 2, copies=2, window=100)
    few = sum(r[5] == 2 for r in rows_of(False))
    assert out.count() == N + 2 * (few - 1)
    assert out.filter((F.col("cls") == 2) & ((F.col("a") < 0.5) | (F.col("b") < 0.7))).count() == 0


def test_replay_in_chunks_equals_one_loop(streams):
    x = np.array([r[1:4] for r in rows_of(False)])
    y = np.array([r[4] for r in rows_of(False)])
    losses = {"plain": {}, "l1": {"l1": 1.0}, "pa2": {"loss": "pa2"}}
    out = replay(streams[0][0], {n: (lambda k, o=o: OnlineLinear(k, **o)) for n, o in losses.items()}, FEATS, "y", 500)
    got = {r["step"]: r for r in out.collect()}
    for name, opts in losses.items():
        want = replay_rows(OnlineLinear(3, **opts), x, y)
        assert [got[s][name] for s in range(1, N + 1)] == pytest.approx(list(want), rel=1e-12)


def test_drift_window_drops_old_blocks():
    w = BlockAdwin()
    assert not any(w.add(1000, 100, 100) for _ in range(5))
    assert w.add(1000, 500, 500) and len(w.window) == 1
    assert not w.add(1000, 100, 100)  # getting better is no alarm
