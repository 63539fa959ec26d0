"""Runs of all tasks of a dataset from one scan, against each task on its own."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.fixed_values import LIBRARIES
from tidemark.operators import baselines, runs
from tidemark.operators.metrics import classification_checkpoints, long_predictions, regression_checkpoints
from tidemark.plans import stream as stream_module
from tidemark.plans.stream import prepare
from tidemark.queries import QUERIES
from tidemark.sources import tables

KINDS = ["view", "click", "error", None]


@pytest.fixture(params=[3, 137, 1000])
def folder(spark, tmp_path, request):
    """Events with null values, types and times, whose number both rules cut differently."""
    start = datetime.datetime(2024, 1, 1)
    rows = [
        (i * 7, None if i and i % 11 == 0 else start + datetime.timedelta(seconds=i * i % 5000), i % 13, KINDS[(i * i + i // 9) % (3 if i < 5 else 4)],
         None if i % 17 == 5 else float("nan") if i % 19 == 7 else float(i * 31 % 400), f'{{"k": {i % 5}}}')
        for i in range(request.param)
    ]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).orderBy(F.rand(3)).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_tasks_share_a_scan(spark, folder, monkeypatch):
    calls, scan = [], baselines.scan
    monkeypatch.setattr(baselines, "scan", lambda *a, **k: calls.append(1) or scan(*a, **k))
    got = {}
    for r in runs.dataset_runs(spark, folder, "events").collect():
        got[r["track"], r["library"], r["model"], r["step"]] = r
    assert len(calls) == 1

    expected = {}
    for task, sets in runs.DATASETS.items():
        name, ts = sets["events"]
        st = runs.stream(spark, folder, name)
        for library, rule in zip(LIBRARIES, ("ceil", "floor")):
            if task == "Regression":
                models = ["mean", "no_change"]
                out = regression_checkpoints(baselines.baseline_regressors(st, tuple(models)), st.n, models, st.target, rule)
            else:
                models = ["last_class", "majority"]
                preds = baselines.baseline_classifiers(st, baselines.class_list(st))
                out = classification_checkpoints(long_predictions(preds, models, st.target), st.n, rule, runs.POSITIVE[name])
            for r in out.join(runs.clock(st, ts, rule), "step", "left").collect():
                expected[task, library, runs.SHOWN_AS[library][r["model"]], r["step"]] = r
    assert got.keys() == expected.keys()
    for key, r in expected.items():
        for c, v in r.asDict().items():
            if c in got[key].asDict() and c not in ("model", "step"):
                assert got[key][c] == (None if v is None else pytest.approx(v, nan_ok=True)), (key, c)


def test_runs_prepare_targets_only(spark, tmp_path, monkeypatch):
    """Runs read neither features nor blocks: their stream has no features and no file for every few rows."""
    start = datetime.datetime(2024, 1, 1)
    events = [(i, start + datetime.timedelta(minutes=i % 70), i % 5, KINDS[i % 4], float(i % 50), '{"k": 1}') for i in range(2000)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).orderBy(F.rand(5)).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(stream_module, "FILE_ROWS", 10)
    got = {tuple(r) for r in runs.dataset_runs(spark, str(tmp_path), "events").collect()}
    tables_made = {base for _, folder, base in tables._prepared if folder == str(tmp_path)}
    assert tables_made == {"ev_targets"}
    narrow = tables.target_stream(spark, str(tmp_path), "ev_bin")
    assert len(narrow.df.inputFiles()) <= stream_module.parallelism(narrow.df, 4)
    assert {"props", "user_id", "hour", "u", "k"}.isdisjoint(narrow.df.columns)

    whole = tables.stream(spark, str(tmp_path), "ev_bin")
    columns = ["step", "event_id", "ts", "event_type", "value", "is_error"]
    assert sorted(narrow.df.select(columns).collect()) == sorted(whole.df.select(columns).collect(), key=lambda r: r["step"])
    assert tables.target_stream(spark, str(tmp_path), "ev_bin").df.columns == whole.df.columns
    assert {tuple(r) for r in runs.dataset_runs(spark, str(tmp_path), "events").collect()} == got


def test_columns_are_computed_once(spark):
    """Ranges are taken from a first pass over the input; what is made of it is not computed there."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def twice(x):
        made.add(1)
        return 2 * x

    rows = spark.range(5000, numPartitions=4).select("id", (F.col("id") * 3).alias("x"))
    st = prepare(rows, ("id",), "y", ("y",), columns=(F.col("id"), twice("x").alias("y")))
    assert st.df.where(F.col("y") != 6 * (F.col("step") - 1)).count() == 0
    assert (st.n, made.value, st.df.columns) == (5000, 5000, ["_part", "id", "y", "step"])


def test_best_binary_from_shared_scans(spark, tmp_path, monkeypatch):
    """The frame of the binary task: two scans for the runs of all tasks, and the values of a plain loop."""
    n, start = 130, datetime.datetime(2024, 1, 1)
    kinds = [["view", "error", "click"][(i * i + i // 7) % 3] for i in range(n)]
    events = [(i, start + datetime.timedelta(minutes=i), i % 5, kinds[i], float(i % 50), '{"k": 1}') for i in range(n)]
    orders = [(i, start + datetime.timedelta(days=i), float(i), "FOP"[i % 3], "5-LOW") for i in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    columns = "o_orderkey long, o_orderdate timestamp, o_totalprice double, o_orderstatus string, o_orderpriority string"
    spark.createDataFrame(orders, columns).write.parquet(f"{tmp_path}/orders.parquet")
    calls, scan = [], baselines.scan
    monkeypatch.setattr(baselines, "scan", lambda *a, **k: calls.append(1) or scan(*a, **k))
    got = {(r["library"], r["model"]): r["value"] for r in QUERIES["c11_best_binary"](spark, str(tmp_path)).collect() if r["metric"] == "Accuracy"}
    assert len(calls) == 2

    labels = [int(k == "error") for k in kinds]
    preds = {
        "last_class": [None, *labels[:-1]],
        "majority": [None if i == 0 else int(sum(labels[:i]) * 2 > i) for i in range(n)],
    }
    means = {}
    for library, every, tail in ((LIBRARIES[0], 3, False), (LIBRARIES[1], 2, True)):
        steps = [s for s in range(1, n + 1) if s % every == 0 or (tail and s == n)]
        for model, pred in preds.items():
            values = [sum(p == y for p, y in zip(pred[1:s], labels[1:s])) / (s - 1) for s in steps]
            means[library, runs.SHOWN_AS[library][model]] = sum(values) / len(values)
    best = max(means.values())
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in means.items() if v > best - 1e-7}
