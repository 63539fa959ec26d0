"""Mondrian partitions that grow with the stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.mondrian import Cell, Partition, blended, compiled, leaf_of, mondrian_forest, node_values
from tidemark.plans.blocks import Blocks
from tidemark.plans.stream import prepare


def inside(node: Cell):
    """Children halve the range at the cut, in time order, and lie in the box of the node."""
    if not node.children:
        return 1
    left, right = node.children
    f, cut = node.feature, node.cut
    assert node.low[f] - 1e-12 <= cut <= node.high[f] + 1e-12
    assert left.high[f] <= cut + 1e-12 and right.low[f] >= cut - 1e-12
    for c in node.children:
        assert c.time > node.time
        assert (c.low >= node.low - 1e-12).all() and (c.high <= node.high + 1e-12).all()
    return inside(left) + inside(right)


def test_boxes_grow_and_counts_are_carried():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        tree = Partition(np.random.default_rng([seed, 1]), 3, leaves=12)
        tree.extend(np.zeros(2), np.ones(2))
        assert inside(tree.root) == tree.count == 12
        tree = Partition(np.random.default_rng([seed, 1]), 3, leaves=200)
        tree.most = 6
        tree.extend(np.zeros(2), np.ones(2))
        for n in tree.nodes():
            n.sums = np.array([4.0, 8.0, 20.0])
        tree.most = 60
        for _ in range(4):
            a, b = rng.normal(0, 4, 2), rng.normal(0, 4, 2)
            low, high = np.minimum(a, b), np.maximum(a, b)
            before = [(n, n.sums.copy()) for n in tree.nodes()]
            tree.extend(low, high)
            assert inside(tree.root) == tree.count <= 60
            assert {id(n) for n, _ in before} & {id(n) for n in tree.nodes()}
            assert (tree.root.low <= low).all() and (tree.root.high >= high).all()
            assert all((n.sums == s).all() for n, s in before)
            assert max((n.time for n in tree.nodes() if n.children), default=0) <= tree.limit
            assert tree.root.sums[0] == 4.0


def test_time_of_a_new_split_follows_the_new_range():
    """A range grown from [0, 1] to [0, 1 + d] gets a split above with chance 1 - exp(-d * time of the old split)."""
    d, hits, want = 0.5, 0, []
    for seed in range(3000):
        tree = Partition(np.random.default_rng(seed), 3, leaves=2)
        tree.extend(np.zeros(1), np.ones(1))
        old, tree.most = tree.root, 3
        want.append(1 - np.exp(-d * old.time))
        tree.extend(np.zeros(1), np.array([1 + d]))
        hits += tree.root is not old
    assert hits / 3000 == pytest.approx(np.mean(want), abs=0.03)


def test_blend_equals_the_sum_over_all_prunings():
    rng = np.random.default_rng(3)
    tree = Partition(rng, 2, leaves=5)
    tree.extend(np.zeros(2), np.ones(2))
    nodes = tree.nodes()
    for n in nodes:
        n.loss, n.sums = float(rng.uniform(0, 3)), rng.integers(1, 9, 2).astype(float)
    value = node_values(nodes, 2)
    place = {id(n): i for i, n in enumerate(nodes)}

    def prunings(node):
        """(weight, leaves) of all subtrees below a node: half stops at each inner node."""
        own = (np.exp(-node.loss), [place[id(node)]])
        if not node.children:
            return [own]
        both = [(0.5 * a * b, x + y) for a, x in prunings(node.children[0]) for b, y in prunings(node.children[1])]
        return [(0.5 * own[0], own[1]), *both]

    def way(to):
        out, n = [], tree.root
        x = (to.low + to.high) / 2
        while True:
            out.append(place[id(n)])
            if not n.children:
                return out
            n = n.children[int(x[n.feature] > n.cut)]

    mixed, every = blended(nodes, value, 1.0), prunings(tree.root)
    for leaf in (n for n in nodes if not n.children):
        path = way(leaf)
        want = sum(w * value[next(i for i in path if i in some)] for w, some in every) / sum(w for w, _ in every)
        assert mixed[place[id(leaf)]] == pytest.approx(want)


def test_rows_beyond_the_first_box_are_told_apart(spark):
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.uniform(0, 1, 600), rng.uniform(50, 51, 1800)])
    rows = [(i, float(v), float(rng.uniform()), 10.0 if v > 50.5 else 0.0, int(v > 50.5)) for i, v in enumerate(a)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double, c int")
    st = prepare(df, ("id",), "y", ("a", "b"))
    out = mondrian_forest(Blocks(st, 6), ["a", "b"], F.col("y"), leaves=200)
    miss = out.where("step > 1800").agg(F.avg(F.abs(F.col("y") - F.col("mondrian")))).first()[0]
    assert miss < 2.5  # the mean alone misses by 5
    out = mondrian_forest(Blocks(st, 6), ["a", "b"], F.col("c"), classes=2, leaves=200)
    assert out.where("step > 1800").agg(F.avg((F.col("c") == F.col("mondrian")).cast("double"))).first()[0] > 0.85


def test_routes():
    tree = Partition(np.random.default_rng(5), 2, leaves=20)
    tree.extend(np.zeros(3), np.ones(3))
    nodes, x = tree.nodes(), np.random.default_rng(6).uniform(-0.5, 1.5, (500, 3))
    got = leaf_of(x, *compiled(nodes))
    for row, at in zip(x, got, strict=True):
        n = tree.root
        while n.children:
            n = n.children[int(row[n.feature] > n.cut)]
        assert nodes[at] is n
