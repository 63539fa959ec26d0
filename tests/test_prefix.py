"""Prefix scans against plain loops, on both scan levels, and the checkpoint rules."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators.baselines import baseline_classifiers, baseline_regressors
from tidemark.plans import prefix
from tidemark.plans.checkpoints import checkpoint_steps, interval
from tidemark.plans.stream import prepare


def make(spark, n, by=False):
    rows = [(i, i % 3, float((i * 37) % 101) - 20, "abc"[(i * i) % 3]) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, key int, value double, label string").orderBy(F.rand(7))
    return rows, prepare(df, ("id",), "value", ("value",), by=("key",) if by else ())


@pytest.mark.parametrize("group, chunk", [(4096, 64), (4, 7), (4, 2)])
@pytest.mark.parametrize("by", [False, True])
def test_scan_equals_loop(spark, monkeypatch, group, chunk, by):
    monkeypatch.setattr(prefix, "GROUP", group)
    rows, st = make(spark, 400, by)
    st.__dict__["chunk_rows"] = chunk
    got = {r["id"]: r for r in baseline_regressors(st, factor=0.8).collect()}
    state = {}
    for i, key, value, _ in rows:
        n, s, fn, fs, last = state.get(key if by else 0, (0, 0.0, 0.0, 0.0, 0.0))
        assert got[i]["step"] == n + 1
        assert got[i]["mean"] == pytest.approx(s / n if n else 0.0)
        assert got[i]["fading"] == pytest.approx(fs / fn if fn else 0.0)
        assert got[i]["no_change"] == last
        state[key if by else 0] = (n + 1, s + value, fn * 0.8 + 1, fs * 0.8 + value, value)


def test_hot_key_is_chunked(spark):
    """A key with nearly all rows is cut into chunks like a single stream."""
    rows = [(i, 0 if i % 10 else i, float(i % 7)) for i in range(3000)]
    st = prepare(spark.createDataFrame(rows, "id int, key int, value double"), ("id",), "value", by=("key",))
    st.__dict__["chunk_rows"] = 50
    hot = [r for r in rows if r[1] == 0]
    got = {r["id"]: r["mean"] for r in baseline_regressors(st, ("mean",)).filter("key = 0").collect()}
    total = 0.0
    for n, (i, _, v) in enumerate(hot):
        assert got[i] == pytest.approx(total / n if n else 0.0)
        total += v


def test_fading_mean_does_not_underflow(spark):
    n = 20_000
    st = prepare(spark.range(n).select("id", (F.col("id") % 5).cast("double").alias("value")), ("id",), "value")
    st.__dict__["chunk_rows"] = 262_144
    last = baseline_regressors(st, ("fading",)).filter(F.col("step") == n).collect()[0]["fading"]
    s = w = 0.0
    for i in range(n - 1):
        s, w = s * 0.99 + i % 5, w * 0.99 + 1
    assert last == pytest.approx(s / w, rel=1e-12)


def test_majority_ties_take_the_smallest_label(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "id int, label string")
    st = prepare(df, ("id",), "label")
    got = [r["majority"] for r in baseline_classifiers(st, ["a", "b", "c"]).orderBy("step").collect()]
    assert got == [None, "b", "a"]


@pytest.mark.parametrize("group", [4096, 4])
@pytest.mark.parametrize("file_rows", [25_000, 1])
def test_previous_text_without_sorting_for_totals(spark, monkeypatch, group, file_rows):
    """Rows at chunk ends hand on their text, missing or not, in both ways to deal out chunks; no aggregate sorts the rows for it."""
    monkeypatch.setattr(prefix, "GROUP", group)
    monkeypatch.setattr(prefix, "FILE_ROWS", file_rows)
    labels = [None if i % 4 in (1, 2) and i % 3 else "abc"[i * i % 3] for i in range(100)]
    st = prepare(spark.createDataFrame(list(enumerate(labels)), "id int, label string").orderBy(F.rand(2)), ("id",), "label")
    st.__dict__["chunk_rows"] = 6
    for out in (baseline_classifiers(st, ["a", "b", "c"]), prefix.scan(st, lags={"last_class": F.col("label")})):
        assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
        assert [r["last_class"] for r in out.orderBy("step").collect()] == [None, *labels[:-1]]


@pytest.mark.parametrize("n", [1, 49, 50, 51, 578])
def test_checkpoint_rules(spark, n):
    rows = spark.range(1, n + 1).withColumnRenamed("id", "step")
    for rule in ("floor", "ceil"):
        got = sorted(r[0] for r in checkpoint_steps(rows, n, rule).collect())
        step = max(1, n // 50) if rule == "floor" else math.ceil(n / 50)
        assert interval(n, rule) == step
        want = list(range(step, n + 1, step))
        if rule == "floor" and want[-1] != n:
            want.append(n)
        assert got == want


def test_unknown_length():
    assert (interval(None, "floor"), interval(None, "ceil")) == (200, 1000)
