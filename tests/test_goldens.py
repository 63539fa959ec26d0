"""Published results on the ChickWeights stream (578 rows; set CHICKWEIGHTS_CSV to a copy of the public data)."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators.baselines import baseline_regressors
from tidemark.operators.compare import final_metrics
from tidemark.operators.metrics import regression_checkpoints
from tidemark.operators.replay import OnlineLinear, replay
from tidemark.plans.stream import prepare

PATH = os.environ.get("CHICKWEIGHTS_CSV", "")
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="dataset not at hand")


@pytest.fixture(scope="module")
def chicks(spark):
    rows = spark.createDataFrame(
        [(i, *map(float, line.split(","))) for i, line in enumerate(open(PATH).read().split("\n")[1:]) if line],
        "line int, time double, chick double, diet double, target double",
    )
    return prepare(rows, ("line",), "target", ("time", "chick", "diet"))


def final(df, n, model, rule):
    ck = regression_checkpoints(df, n, [model], "target", rule).withColumns(
        {"library": F.lit("x"), "track": F.lit("Regression"), "dataset": F.lit("ChickWeights")}
    )
    row = final_metrics(ck).collect()[0]
    return ck.count(), row["MAE"], row["RMSE"]


@pytest.mark.parametrize(
    "model, rule, checkpoints, mae, rmse",
    [
        ("mean", "floor", 53, 48.01331024746602, 68.00944910938274),
        ("mean", "ceil", 48, 47.811164513790345, 67.8136631540706),
        ("fading", "ceil", 48, 30.966497483088013, 45.175765247561856),
        ("no_change", "ceil", 48, 29.73020774445815, 50.52978447041271),
    ],
)
def test_baselines(chicks, model, rule, checkpoints, mae, rmse):
    got = final(baseline_regressors(chicks), chicks.n, model, rule)
    assert got == (checkpoints, pytest.approx(mae, rel=1e-12), pytest.approx(rmse, rel=1e-12))


@pytest.mark.parametrize("chunk_rows", [1_000_000, 100])
def test_linear(chicks, chunk_rows):
    models = {
        "plain": lambda n: OnlineLinear(n),
        "l2": lambda n: OnlineLinear(n, l2=1.0),
        "l1": lambda n: OnlineLinear(n, l1=1.0),
    }
    out = replay(chicks, models, ["time", "chick", "diet"], "target", chunk_rows).withColumnRenamed("_y", "target")
    want = {
        "plain": (22.64258035797672, 35.54265613635042),
        "l2": (24.2243795717522, 37.101298843513874),
        "l1": (22.64243787436375, 35.58530297999864),
    }
    for name, (mae, rmse) in want.items():
        assert final(out, chicks.n, name, "floor") == (53, pytest.approx(mae, rel=1e-12), pytest.approx(rmse, rel=1e-12))
