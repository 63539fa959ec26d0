"""Comparison rules on hand-made checkpoint tables."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import compare as cmp
from tidemark.operators.metrics import classification_checkpoints, regression_checkpoints


def runs_of(spark, n):
    rows = [("River", "t", "m", "d", i, None if i % 4 == 0 else float(i), 1.0, float(i)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "library string, track string, model string, dataset string, step long, Accuracy double, memory_mb double, time_s double")


@pytest.mark.parametrize("n", [2, 3, 29, 30, 53])
def test_final_metrics(spark, n):
    row = cmp.final_metrics(runs_of(spark, n)).collect()[0]
    tail = list(range(1, n + 1))[-max(3, int(n * 0.1)) :]
    values = [float(i) for i in tail if i % 4]
    assert row["Accuracy"] == pytest.approx(sum(values) / len(values))
    assert (row["step"], row["time_s"]) == (n, float(n))


def test_ties_share_the_first_rank(spark):
    df = spark.createDataFrame(
        [("d", "River", "a", 0.5), ("d", "River", "b", 0.5), ("d", "CapyMOA", "c", 0.4)], "dataset string, library string, model string, Accuracy double"
    )
    assert {r["model"] for r in cmp.best_per_dataset(df, "Accuracy").collect()} == {"a", "b"}
    assert {r["model"] for r in cmp.best_per_dataset(df, "Accuracy", maximize=False).collect()} == {"c"}


def test_constant_column_is_not_scaled(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0), ("b", 2.0, 3.0)], "m string, x double, y double")
    assert sorted(tuple(r) for r in cmp.min_max(df, ["x", "y"]).collect()) == [("a", 2.0, 0.0), ("b", 2.0, 1.0)]


def test_model_list_is_case_sensitive(spark):
    df = spark.createDataFrame([("CapyMOA", "SAMkNN"), ("CapyMOA", "WeightedkNN"), ("River", "AdaBoost"), ("Other", "x")], "library string, model_normalized string")
    assert {r[1] for r in cmp.allowed_multiclass(df).collect()} == {"WeightedkNN", "AdaBoost", "x"}


def test_macro_f1_keeps_classes_seen_before(spark):
    rows = [(1, "a", "a"), (2, "b", "a"), (3, "a", "a"), (4, "a", "c")]
    df = spark.createDataFrame(rows, "step long, y string, pred string").withColumn("model", F.lit("m"))
    got = {r["step"]: r for r in classification_checkpoints(df, 4, "floor", "a").collect()}
    assert got[4]["Accuracy"] == 0.5
    assert got[4]["MacroF1"] == pytest.approx((2 * 2 / (3 + 3) + 0 + 0) / 3)
    assert got[4]["Precision"] == pytest.approx(2 / 3) and got[4]["Recall"] == pytest.approx(2 / 3)
    assert got[2]["MacroF1"] == pytest.approx((2 / 3 + 0) / 2)


def test_regression_scores_only_finite_pairs(spark):
    rows = [(1, 1.0, 2.0), (2, float("nan"), 1.0), (3, 4.0, float("inf")), (4, None, 1.0), (5, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "step long, y double, m double")
    last = {r["step"]: r for r in regression_checkpoints(df, 5, ["m"], "y").collect()}[5]
    assert (last["n_scored"], last["MAE"]) == (2, 1.5)
    assert last["RMSE"] == pytest.approx((5 / 2) ** 0.5)
