"""Drift tests on errors of any scale, missing targets and features, and samples that do not lean to the start."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import uniform
from tidemark.operators import mondrian, rules
from tidemark.operators.bayes import gaussian_nb
from tidemark.operators.drift import BlockAdwin
from tidemark.operators.ensembles import smallest
from tidemark.operators.linear import LinearBlock, block_scaled, normal_equations
from tidemark.operators.replay import OnlineLinear, replay_rows
from tidemark.operators.trees import Forest, TreeSpec
from tidemark.plans.blocks import Blocks, run_blocks
from tidemark.plans.stream import prepare

FEATS = ("a", "b")


def alarms(blocks):
    adwin = BlockAdwin()
    return any([adwin.add(len(e), e.sum(), (e * e).sum(), e.max()) for e in blocks])


@pytest.mark.parametrize("scale", [1e-4, 1.0, 1e5])
def test_drift_on_squared_errors(scale):
    rng = np.random.default_rng(0)
    series = [[scale * rng.normal(size=400) ** 2 for _ in range(5)] for _ in range(100)]
    assert sum(map(alarms, series)) <= 1
    assert all(alarms([*s[:3], 6 * s[3], 6 * s[4]]) for s in series)


@pytest.fixture(scope="module")
def halves(spark):
    """A stream in which every second target is missing and the others are 10, and one with some features missing."""
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (400, 2))
    rows = [(i, float(x[i, 0]), float(x[i, 1]) if i % 5 else None, None if i % 2 else 10.0, None if i % 2 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y double, c int")
    return prepare(df, ("id",), "y", FEATS), prepare(df, ("id",), "c", FEATS)


def late(df, name):
    return [r[0] for r in df.filter(F.col("step") > 200).select(name).collect()]


def test_missing_targets_are_not_learned(halves):
    reg, cls = halves
    b = Blocks(reg, 4)
    assert late(Forest(b, TreeSpec("p", kind="reg"), list(FEATS), F.col("y")).run(), "p") == pytest.approx([10.0] * 200)
    assert late(rules.model_rules(b, list(FEATS), F.col("y")), "model_rules") == pytest.approx([10.0] * 200)
    assert late(mondrian.mondrian_forest(b, list(FEATS), F.col("y")), "mondrian") == pytest.approx([10.0] * 200)
    assert late(normal_equations(b, list(FEATS), "y"), "least_squares") == pytest.approx([10.0] * 200, abs=0.1)
    got = late(Forest(Blocks(cls, 4), TreeSpec("p"), list(FEATS), F.col("c"), 2).run(), "p")
    assert set(got) == {1.0}
    model = LinearBlock("sq", list(FEATS), F.col("y"), rate=0.45)
    full = Blocks(prepare(reg.df.where("y is not null").select("id", *FEATS, "y"), ("id",), "y", FEATS), 4)
    last = lambda b_: run_blocks(b_, [model], block_scaled(b_, list(FEATS))).orderBy(F.desc("step")).first()["sq"]
    assert last(b) == pytest.approx(last(full), rel=0.2)
    nb = gaussian_nb(cls, [0, 1], list(FEATS))
    assert set(late(nb, "naive_bayes")) == {1}


def test_gradient_trees_use_their_own_output(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (1200, 2))
    y = np.where(x[:, 0] > 0.5, 10.0, 2.0)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(1200)], "id int, a double, b double, y double")
    b = Blocks(prepare(df, ("id",), "y", FEATS), 6)
    for spec in (TreeSpec("p", kind="gradient", shrink=1.0), TreeSpec("p", kind="gradient", members=5, shrink=0.5)):
        out = Forest(b, spec, list(FEATS), F.col("y")).run().filter("step > 800")
        assert out.select(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2)))).first()[0] < 2.0  # a mean alone leaves 16


def test_replay_passes_over_missing_targets():
    x, y = np.ones((6, 1)), np.array([1.0, np.nan, 1.0, np.nan, 1.0, 1.0])
    out = replay_rows(OnlineLinear(1), x, y)
    assert np.isfinite(out).all() and out[-1] > 0


def test_smallest_rows_are_exact(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).cast("int").alias("block"), uniform(F.lit(1), F.col("id")).alias("u"), F.col("id").alias("step")).repartition(7)
    got = {(r.block, r.step) for r in smallest(rows, 50).collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r.block, []).append((r.u, r.step))
    assert got == {(b, s) for b, all_ in by.items() for _, s in sorted(all_)[:50]}
    # a hash of 53 bits: the sample of a long block does not lean to its start
    assert rows.select(F.countDistinct("u")).first()[0] == 20_000


def test_forecasts_with_a_horizon_and_missing_values(spark):
    """A forecast uses values known ``horizon`` rows before and blocks before; a plain loop over the same blocks agrees."""
    import random

    import numpy as np

    from tidemark.operators.anomaly import forecast_scorer, forecasts
    from tidemark.plans.blocks import Blocks
    from tidemark.plans.stream import prepare

    rnd = random.Random(4)
    y = [10.0, 12.0]
    for _ in range(598):
        y.append(0.6 * y[-1] + 0.3 * y[-2] + rnd.random())
    y[50], y[300] = None, None
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "i bigint, y double")
    blocks = Blocks(prepare(df, ("i",), "y", ()), 6)
    got = {r["step"]: r["forecast"] for r in forecasts(blocks, "y", order=2, horizon=3).collect()}
    assert sorted(got) == list(range(1, 601))
    for step in (1, 99, 100, 101, 150, 304, 305, 600):
        block = (step - 1) // 100
        rows = [(y[t - 3], y[t - 4], y[t]) for t in range(4, block * 100) if None not in (y[t - 3], y[t - 4], y[t])]
        if block == 0 or y[step - 4] is None or y[step - 5] is None:
            assert got[step] is None
            continue
        x = np.array([(1.0, a, b) for a, b, _ in rows])
        w = np.linalg.lstsq(x, np.array([c for *_, c in rows]), rcond=None)[0]
        assert abs(got[step] - w @ [1.0, y[step - 4], y[step - 5]]) < 1e-2
    scores = {r["step"]: r["predictive"] for r in forecast_scorer(blocks, "y", horizon=3).collect()}
    assert scores[301] == 0.0 and scores[50] == 0.0 and max(scores.values()) <= 1.0
