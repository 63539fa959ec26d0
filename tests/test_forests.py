"""Trees that follow the stream: edges from all rows, growth without a depth, drift below nodes and of members, options, votes by error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import rules
from tidemark.operators.drift import BlockAdwin
from tidemark.operators.edges import BINS, Edges, carry
from tidemark.operators.trees import OPTION, Forest, Routes, TreeSpec, draws, majority_weights
from tidemark.plans.blocks import Blocks
from tidemark.plans.stream import prepare

FEATS = ["a", "b"]


def stream_of(spark, x, y):
    kind = "y int" if np.asarray(y).dtype.kind == "i" else "y double"
    rows = [(i, *map(float, r), t.item()) for i, (r, t) in enumerate(zip(x, np.asarray(y), strict=True))]
    return prepare(spark.createDataFrame(rows, f"id int, a double, b double, {kind}"), ("id",), "y", tuple(FEATS))


def late(out, name, after):
    return np.array([(r["y"], r[name]) for r in out.filter(F.col("step") > after).select("y", name).orderBy("step").collect()], float)


def test_edges_follow_all_rows(spark):
    rng = np.random.default_rng(0)
    parts = [rng.normal(size=4000), rng.normal(50, 1, size=4000), rng.normal(-9, 3, size=4000)]
    edges, seen = Edges(["a"]), np.zeros(0)
    for part in parts:
        seen = np.concatenate([seen, part])
        edges.add(spark.createDataFrame([(float(v),) for v in part], "a double"))
        shares = np.bincount(edges.bins_of(seen[:, None])[:, 0], minlength=BINS) / len(seen)
        assert shares.max() <= 2.6 / BINS
        want = np.arange(len(edges.points[0])) / (len(edges.points[0]) - 1)
        assert np.abs(np.searchsorted(np.sort(seen), edges.points[0]) / len(seen) - want).max() < 0.015
    still = edges.of[0].copy()
    assert edges.add(spark.createDataFrame([(float(v),) for v in rng.choice(seen, 4000)], "a double")) is None
    assert (edges.of[0] == still).all()
    assert edges.add(spark.createDataFrame([], "a double")) is None


def test_histograms_are_carried_over():
    m = carry(np.array([1.0, 2.0, 3.0]), np.array([1.5, 3.0]), 0.0, 4.0, 4)
    assert m.sum(1).tolist() == [1.0] * 4
    assert (np.array([2.0, 2.0, 2.0, 2.0]) @ m).tolist() == [3.0, 3.0, 2.0, 0.0]
    assert carry(np.array([5.0]), np.array([5.0, 7.0]), 5.0, 9.0, 3)[0].tolist() == [1.0, 0.0, 0.0]  # a single value stays where it is


def moved(n=4000, seed=1):
    """The feature lies in [0, 1] at first, then in [100, 101], where alone it tells the target."""
    rng = np.random.default_rng(seed)
    a = np.concatenate([rng.uniform(0, 1, n // 4), rng.uniform(100, 101, n - n // 4)])
    return np.stack([a, rng.uniform(size=n)], 1), np.where(a > 100.5, 1, 0)


def test_splits_where_a_feature_has_moved(spark):
    x, y = moved()
    st = stream_of(spark, x, y)
    got = late(Forest(Blocks(st, 8), TreeSpec("p"), FEATS, F.col("y"), 2).run(), "p", 3000)
    assert (got[:, 0] == got[:, 1]).mean() > 0.9
    ys = np.where(x[:, 0] > 100.5, 10.0, 0.0)
    for out, name in (
        (Forest(Blocks(stream_of(spark, x, ys), 8), TreeSpec("p", kind="reg"), FEATS, F.col("y")).run(), "p"),
        (rules.model_rules(Blocks(stream_of(spark, x, ys), 8), FEATS, F.col("y")), "model_rules"),
    ):
        got = late(out, name, 3000)
        assert np.abs(got[:, 0] - got[:, 1]).mean() < 2.0


def test_trees_grow_and_memory_does_not(spark):
    """A board of 16 by 16 fields needs over 64 leaves; only some of the leaves hold histograms."""
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 16, (60_000, 2))
    y = ((x[:, 0].astype(int) // 2 * 5 + x[:, 1].astype(int) // 2 * 3) % 7).astype(int)
    st = stream_of(spark, x, y)
    forest = Forest(Blocks(st, 8), TreeSpec("p", delta=0.05, tie=0.5, active=40), FEATS, F.col("y"), 7)
    got = late(forest.run(), "p", 52_500)
    leaves = forest.trees[0].leaves()
    assert len(leaves) > 64
    assert sum(n.hist is not None for n in leaves) <= 40
    assert (got[:, 0] == got[:, 1]).mean() > 0.5


def drifting(passing: bool, n=21_000, blocks=14):
    """Left of 0.5 a simple rule turns round in the middle of the stream, for good or for a block; right of it a board, slow to learn, stays."""
    rng = np.random.default_rng(3)
    x, step = rng.uniform(0, 1, (n, 2)), np.arange(n)
    turned = (step >= n // 2) & ((step < n // 2 + n // blocks) | (not passing))
    y = np.where(turned, x[:, 1] <= 0.5, x[:, 1] > 0.5).astype(int)
    board = (x[:, 0] * 8).astype(int) + 3 * (x[:, 1] * 8).astype(int)
    return x, np.where(x[:, 0] < 0.5, y, 2 + board % 3).astype(int)


@pytest.mark.parametrize("passing, other", [(False, None), (True, "cut")])
def test_alternates(spark, passing, other):
    """Better than no answer to a drift that lasts, and better than cutting off where the old rule comes back."""
    x, y = drifting(passing)
    st, right = stream_of(spark, x, y), {}
    for way in (other, "alternate"):
        got = late(Forest(Blocks(st, 14), TreeSpec("p", delta=0.05, tie=0.3, on_drift=way), FEATS, F.col("y"), 5).run(), "p", len(y) // 2)
        right[way] = (got[:, 0] == got[:, 1]).mean()
    assert right["alternate"] > right[other] + 0.01, right


def test_background_trees_replace_members(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 1, (9000, 2))
    slow = rng.uniform(size=len(x)) < np.clip((np.arange(len(x)) - 4500) / 2500, 0, 1)  # the rule turns round little by little
    y = np.where(slow, x[:, 0] <= 0.5, x[:, 0] > 0.5).astype(int)
    st = stream_of(spark, x, y)
    got = {}
    for warn in (0.2, 1e-300):  # a level that never warns: fresh members on drift
        spec = TreeSpec("p", members=3, rate=6.0, reset="member", vote="accuracy", warn=warn, drift=0.002)
        got[warn] = late(Forest(Blocks(st, 12), spec, FEATS, F.col("y"), 2).run(), "p", 4500)
    share = {w: (g[:, 0] == g[:, 1]).mean() for w, g in got.items()}
    assert share[0.2] >= share[1e-300]
    assert (got[0.2][-750:, 0] == got[0.2][-750:, 1]).mean() > 0.9


def test_option_nodes(spark):
    rng = np.random.default_rng(5)
    a = rng.uniform(0, 1, 6000)
    x = np.stack([a, a + rng.normal(0, 0.001, 6000)], 1)  # both features say the same: their splits tie
    st = stream_of(spark, x, np.where(a > 0.5, 10.0, 0.0))
    forest = Forest(Blocks(st, 6), TreeSpec("p", kind="reg", options=4, tie=0.2), FEATS, F.col("y"))
    got = late(forest.run(), "p", 3000)
    root = forest.trees[0].root
    assert root.feature == OPTION and {n.feature for n in root.children} == {0, 1}
    assert forest.trees[0].options <= 4
    assert np.abs(got[:, 0] - got[:, 1]).mean() < 1.0
    nodes = forest.trees[0].nodes()
    routes = Routes.of(nodes, forest.leaf_values(nodes), False, False)
    row, leaf, main = routes.walk(x[:50])
    plain = []
    for r in x[:50]:
        ends, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.feature == OPTION:
                todo += n.children
            elif n.feature >= 0:
                todo.append(n.children[int(r[n.feature] > n.cut)])
            else:
                ends.append(n.stats[1] / n.stats[0] if n.stats[0] else 0.0)
        plain.append(np.mean(ends))
    assert routes.values(50, row, leaf, main) == pytest.approx(plain)


def test_majority_by_error(spark):
    weight, stays, add = majority_weights(np.array([1.0, 0.5, 0.015]), np.array([10.0, 60.0, 60.0]), 100, 55.0, 0.5)
    assert weight.tolist() == [1.0, 0.25, 0.0075] and stays.tolist() == [True, True, False] and add
    x, y = moved()
    y = np.where(np.arange(len(y)) % 3 == 0, 1, y)  # unequal classes
    y[2000:] = 1 - y[2000:]
    st = stream_of(spark, x, y)

    class Watched(Forest):
        seen = []

        def _turn_over(self, vote, cells):
            before = self.weight.copy()
            wrong = np.array([cells.get(i, 3, (6,))[1] for i in range(len(self.trees))])
            super()._turn_over(vote, cells)
            self.seen.append((before, wrong, vote, self.weight.copy()))

    Watched(Blocks(st, 8), TreeSpec("p", vote="majority"), FEATS, F.col("y"), 2).run()
    assert max(len(w) for *_, w in Watched.seen) > 1
    for before, wrong, vote, after in Watched.seen:
        n, missed, classes = vote[0], vote[1], vote[2:]
        chance = 1 - max(classes) / n
        want = [w * (0.5 if e / n > chance else 1.0) for w, e in zip(before, wrong, strict=True)]
        want = [w / max(want) for w in want]
        want = [w for w in want if w >= 0.01] + ([1.0] if missed / n > chance else [])
        assert after.tolist() == pytest.approx(want)


def test_window_of_blocks_stays_small():
    w, plain = BlockAdwin(), []
    for _ in range(5000):
        plain.append(w.add(1000, 100, 100))
    assert not any(plain) and len(w.window) <= 5 * 13
    assert sum(n for n, *_ in w.window) == 5_000_000
    assert w.size == sorted(w.size, reverse=True)
    assert any(w.add(1000, 300, 300) for _ in range(3))


def test_draws_are_poisson_and_repeatable():
    step = np.arange(100_000)
    d = draws(42, 3, step, 6.0)
    assert d.mean() == pytest.approx(6.0, abs=0.05) and d.var() == pytest.approx(6.0, abs=0.15)
    assert (d[500:600] == draws(42, 3, step[500:600], 6.0)).all()
    assert abs(np.corrcoef(d, draws(42, 4, step, 6.0))[0, 1]) < 0.02


def test_many_blocks_keep_one_state(spark):
    x, y = moved(1200)
    st = stream_of(spark, x, y)
    spark_plan = Forest(Blocks(st, 20), TreeSpec("p"), FEATS, F.col("y"), 2).run()
    assert spark_plan.count() == 1200
    assert "Broadcast" not in spark_plan._jdf.queryExecution().toString()
