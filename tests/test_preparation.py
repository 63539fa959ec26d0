"""Edge cases of sources, labels, intervals and sparse features."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as col
from tidemark.operators import prepare as prep
from tidemark.session import scratch_path
from tidemark.sources import files


def test_label_texts(spark):
    df = spark.createDataFrame([("True",), (" yes ",), ("0",), ("no",), ("cat",), (" 12 ",)], "label string")
    got = [tuple(r) for r in df.select(col.label_kind(F.col("label")), col.label_value(F.col("label"))).collect()]
    assert got == [("bool", "true"), ("bool", "true"), ("int", "0"), ("bool", "false"), ("string", "cat"), ("int", "12")]


def test_first_true_label(spark):
    df = spark.createDataFrame([("{'sad': False, 'angry': True, 'calm': True}",), ("{'sad': False}",), ("{broken",)], "t string")
    assert [r[0] for r in df.select(col.first_true(F.col("t"))).collect()] == ["angry", None, None]
    assert [r[0] for r in prep.first_true_index(df, "t").select("label_index").collect()] == [0, 0, 0]
    df = df.unionByName(spark.createDataFrame([("{'sad': True, 'angry': True}",)], "t string"))
    assert sorted(r[0] for r in prep.first_true_index(df, "t").select("label_index").collect()) == [0, 0, 0, 2]


def test_many_and_late_classes(spark):
    df = spark.range(3000).select(F.format_string("{'k%05d': True}", F.col("id")).alias("t"), "id")
    assert prep.first_true_index(df, "t").where("label_index <> id").count() == 0
    labels = spark.range(1, 30).select(F.col("id").alias("step"), F.when(F.col("id") == 11, "cat").otherwise(F.col("id").cast("string")).alias("y"))
    assert prep.needs_encoding(labels, "y").first()[0]
    assert not prep.needs_encoding(labels, "y", first=10).first()[0]
    assert {r.y: r.label_index for r in prep.label_index(labels, "y").collect()} == {y: i for i, y in enumerate(sorted(r.y for r in labels.collect()))}


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), (" -2e3 ",), ("x",), ("",), (None,), ("1d",), ("inf",)], "t string")
    got = [r[0] for r in df.select(col.number_or_zero(F.col("t"))).collect()]
    assert got == [1.5, -2000.0, 0.0, 0.0, 0.0, 0.0, float("inf")]


def test_positional_rows(spark):
    df = spark.createDataFrame([("1,2,3,a",), ("1,b",), ("1,2,3,4,5,c",), ("",), ("1,oops,3,d",)], "value string")
    got = sorted(tuple(r) for r in files.positional_rows(df, 3).select("target", "x0", "x1", "x2").collect())
    assert got == [("a", 1.0, 2.0, 3.0), ("b", 1.0, 0.0, 0.0), ("c", 1.0, 2.0, 3.0), ("d", 1.0, 0.0, 3.0)]


def test_interval_ends_count_once(spark):
    points = spark.sql(
        "SELECT id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, m) AS ts FROM VALUES (1, 600), (2, 1200), (3, 900), (4, 1201) AS t(id, m)"
    )
    windows = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 00:10:00' AS s, timestamp_ntz'2024-01-01 00:20:00' AS e UNION ALL SELECT timestamp_ntz'2024-01-01 00:14:00', timestamp_ntz'2024-01-01 00:16:00'"
    )
    for width in (60, 3600):
        out = prep.interval_label(points, "ts", windows, "s", "e", width)
        assert {r["id"]: r["target"] for r in out.collect()} == {1: 1, 2: 1, 3: 1, 4: 0} and out.count() == 4


def test_sparse_keys_from_first_rows(spark):
    df = spark.range(1, 10_002).select(
        F.col("id").alias("step"),
        F.when(F.col("id") == 10_001, F.create_map(F.lit("late"), F.lit(1.0))).otherwise(F.create_map(F.lit("b"), F.lit(2.0))).alias("x"),
    )
    assert prep.sparse_to_columns(df, "x", key_rows=10_000).columns == ["step", "x_b"]
    out = prep.sparse_to_columns(df, "x")
    assert out.columns == ["step", "x_b", "x_late"]
    assert tuple(out.filter("step = 10001").collect()[0])[1:] == (0.0, 1.0)


def test_csv_needs_target(spark):
    path = scratch_path(spark, "csv")
    spark.createDataFrame([(1, 2)], "a int, b int").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="target"):
        files.read_labelled_csv(spark, path)


def test_task_names(spark):
    stems = ["capymoa_binary_classification", "regression", "x_multiclass_y", "anomaly_detection", "capymoa__time_series"]
    df = spark.createDataFrame([(s,) for s in stems], "s string")
    got = [tuple(r) for r in df.select(files.library_of(F.col("s")), files.task_of(F.col("s"))).collect()]
    assert got == [
        ("CapyMOA", "Binary Classification"), ("River", "Regression"), ("River", "Multiclass Classification"),
        ("River", "Anomaly Detection"), ("CapyMOA", "Time Series"),
    ]


def test_example_text(spark):
    df = spark.createDataFrame([(1, 2.5, 3.0), (0, 1.0, 0.0)], "y int, a double, b double")
    got = [r[0] for r in df.select(files.example_text(F.col("y"), {"a": F.col("a"), "b": F.col("b")})).collect()]
    assert got == ["1 | a:2.5 b:3.0", "-1 | a:1.0 b:0.0"]


def test_poisson_weights(spark):
    u = spark.range(20_000).select(col.uniform(F.lit(1), F.col("id")).alias("u"))
    row = u.select(col.poisson_weight(F.col("u"), 6.0).alias("w")).agg(F.avg("w"), F.var_pop("w")).collect()[0]
    assert row[0] == pytest.approx(6.0, abs=0.1) and row[1] == pytest.approx(6.0, abs=0.3)
