"""Comparison frames over the checkpoint table of all runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.fixed_values import LIBRARIES, METRIC_ALIASES, MODEL_NAMES, MULTICLASS_MODELS
from tidemark.operators import compare as cmp
from tidemark.operators.prepare import ensure_columns, first_alias, looked_up, normal_name
from tidemark.operators.runs import DATASETS, POSITIVE, RULES, SCORERS, SHOWN_AS, anomaly_runs, runs
from tidemark.queries import sql
from tidemark.queries.models import GAUSS, MOMENTS, PREDICTIVE
from tidemark.queries.registry import query, snap
from tidemark.queries.sql import EV, ORD
from tidemark.session import scratch_path
from tidemark.sources import files

A, B = LIBRARIES
TARGETS = {
    "ord_reg": (ORD, "ord", "o_totalprice"), "ev_reg": (EV, "ev", "value"), "ord_multi": (ORD, "ord", "o_orderstatus"),
    "ev_multi": (EV, "ev", "event_type"), "ev_bin": (EV, "ev", "is_error"),
}


def _run_sql(library, task, dataset, name, ts):
    cte, src, y = TARGETS[name]
    rule = RULES[library]
    if task == "Regression":
        body = sql.with_(cte, sql.sized(src, rule), sql.regressors(src, y), sql.regression_checkpoints("preds", rule))
        metrics = "NULL AS Accuracy, NULL AS Precision_, NULL AS Recall, NULL AS F1, NULL AS MicroF1, NULL AS MacroF1, mae AS MAE, rmse AS RMSE, r2 AS R2"
        sizes = {"mean": "2", "no_change": "1"}
    else:
        body = sql.with_(cte, sql.sized(src, rule), sql.classifiers(src, y), sql.classification_checkpoints("preds", rule, POSITIVE[name]))
        metrics = "accuracy AS Accuracy, prec AS Precision_, recall AS Recall, f1 AS F1, accuracy AS MicroF1, macro AS MacroF1, NULL AS MAE, NULL AS RMSE, NULL AS R2"
        sizes = {"last_class": "1", "majority": f"(SELECT count(DISTINCT {y}) FROM {src})"}
    shown = " ".join(f"WHEN '{m}' THEN '{SHOWN_AS[library][m]}'" for m in sizes)
    size = " ".join(f"WHEN '{m}' THEN {v}" for m, v in sizes.items())
    valid = (
        "CAST(n_scored - coalesce(lag(n_scored) OVER (PARTITION BY model ORDER BY ck.step), 0) AS BIGINT)"
    )
    return f"""SELECT * FROM ({body}
SELECT '{library}' AS library, '{task}' AS track, CASE model {shown} END AS model, '{dataset}' AS dataset, ck.step, {metrics},
  {valid} AS valid_updates, (CASE model {size} END) * 8 / 1048576.0::DOUBLE AS memory_mb,
  abs(floor(epoch(s.{ts})) - (SELECT floor(epoch({ts})) FROM {src} WHERE step = 1)) AS time_s
FROM ck JOIN {src} s ON s.step = ck.step)"""


RUNS = "runs AS (\n" + "\nUNION ALL\n".join(
    _run_sql(lib, task, ds, name, ts) for task, sets in DATASETS.items() for ds, (name, ts) in sets.items() for lib in RULES
) + ")"
QUALITY_SQL = {"Accuracy": "Accuracy", "Precision": "Precision_", "Recall": "Recall", "F1": "F1", "MicroF1": "MicroF1", "MacroF1": "MacroF1", "MAE": "MAE", "RMSE": "RMSE"}
FINAL = """fin AS (
  SELECT library, track, model, dataset, """ + ", ".join(f"avg({c}) AS {c}" for c in QUALITY_SQL.values()) + """,
    arg_max(memory_mb, step) AS memory_mb, arg_max(time_s, step) AS time_s, arg_max(valid_updates, step) AS valid_updates, max(step) AS step
  FROM (SELECT *, count(*) OVER (PARTITION BY library, track, model, dataset) AS cn,
          row_number() OVER (PARTITION BY library, track, model, dataset ORDER BY step DESC) AS rn FROM runs)
  WHERE rn <= greatest(3, floor(cn * 0.1)) GROUP BY library, track, model, dataset)"""
REG, MULTI = "track = 'Regression'", "track = 'Multiclass classification'"


def over_runs(tail: str, *ctes: str) -> str:
    return sql.with_(RUNS, *ctes) + tail


def over_final(tail: str, *ctes: str) -> str:
    return sql.with_(RUNS, FINAL, *ctes) + tail


def final(spark, d):
    return cmp.final_metrics(runs(spark, d))


def reg(df):
    return df.filter(F.col("track") == "Regression")


def multi(df):
    return df.filter(F.col("track") == "Multiclass classification")


def both(digits):
    return [snap(c, digits).alias(c) for c in LIBRARIES]


BOTH_SQL = ", ".join(f'snap("{c}", {{d}}) AS "{c}"' for c in LIBRARIES)


def both_sql(d):
    return BOTH_SQL.replace("{d}", str(d))


def pivot_sql(src, keys, value):
    cols = ", ".join(f"avg({value}) FILTER (WHERE library = '{c}') AS \"{c}\"" for c in LIBRARIES)
    return f"SELECT {keys}, {cols} FROM {src} GROUP BY {keys}"


def order_sql(tie):
    return ", ".join([f'"{c}" DESC NULLS LAST' for c in LIBRARIES] + [tie])


# ---------------------------------------------------------------- final metrics and aggregates


@query(
    "a1_final_metrics",
    over_final("SELECT library, track, model, dataset, step, valid_updates, snap(Accuracy, 6) AS accuracy, snap(F1, 6) AS f1, snap(MacroF1, 6) AS macro, snap(MAE, 4) AS mae, snap(RMSE, 4) AS rmse, snap(memory_mb, 9) AS memory_mb, time_s FROM fin"),
)
def a1_final_metrics(spark, d):
    return final(spark, d).select(
        *cmp.RUN, "step", "valid_updates", snap("Accuracy", 6).alias("accuracy"), snap("F1", 6).alias("f1"), snap("MacroF1", 6).alias("macro"),
        snap("MAE", 4).alias("mae"), snap("RMSE", 4).alias("rmse"), snap("memory_mb", 9).alias("memory_mb"), "time_s",
    )


@query("a2_mean_by_model", over_final(f"SELECT library, model, snap(avg(Accuracy), 6) AS accuracy FROM fin WHERE {MULTI} GROUP BY library, model"))
def a2_mean_by_model(spark, d):
    return cmp.mean_by(multi(final(spark, d)), "Accuracy", ["library", "model"]).select("library", "model", snap("Accuracy", 6).alias("accuracy"))


@query("a3_mean_by_dataset", over_runs(f"SELECT dataset, library, model, snap(avg(RMSE), 4) AS rmse FROM runs WHERE {REG} GROUP BY ALL"))
def a3_mean_by_dataset(spark, d):
    out = cmp.mean_by(reg(runs(spark, d)), "RMSE", ["dataset", "library", "model"])
    return out.select("dataset", "library", "model", snap("RMSE", 4).alias("rmse"))


@query("a4_evolution", over_runs(f"SELECT library, step, snap(avg(MAE), 4) AS mae FROM runs WHERE {REG} GROUP BY ALL"))
def a4_evolution(spark, d):
    return cmp.evolution(reg(runs(spark, d)), "MAE", []).select("library", "step", snap("MAE", 4).alias("mae"))


@query("a5_pivot_libraries", over_final(f"SELECT model, {both_sql(6)} FROM ({pivot_sql('fin', 'model', 'MacroF1')})"))
def a5_pivot_libraries(spark, d):
    return cmp.by_library(final(spark, d), "MacroF1", ["model"]).select("model", *both(6))


HEAT_METRICS = ["Accuracy", "MicroF1", "MacroF1"]
LONG_SQL = "long AS (" + " UNION ALL ".join(f"SELECT library, model, '{m}' AS metric, {m} AS value FROM fin WHERE {MULTI} AND {m} IS NOT NULL" for m in HEAT_METRICS) + ")"


@query("a6_pivot_model_metric", over_final(f"SELECT model, metric, {both_sql(6)} FROM ({pivot_sql('long', 'model, metric', 'value')})", LONG_SQL))
def a6_pivot_model_metric(spark, d):
    long = cmp.metric_long(multi(final(spark, d)), HEAT_METRICS)
    return cmp.by_library(long, "value", ["model", "metric"]).select("model", "metric", *both(6))


MINMAX_SQL = ", ".join(
    f'snap(CASE WHEN max("{c}") OVER () > min("{c}") OVER () THEN ("{c}" - min("{c}") OVER ()) / (max("{c}") OVER () - min("{c}") OVER ()) ELSE "{c}" END, 6) AS "{c}"'
    for c in LIBRARIES
)


@query("a7_min_max", over_final(f"SELECT dataset, model, {MINMAX_SQL} FROM ({pivot_sql('fin', 'dataset, model', 'RMSE')}) "))
def a7_min_max(spark, d):
    wide = cmp.by_library(final(spark, d), "RMSE", ["dataset", "model"])
    return cmp.min_max(wide, LIBRARIES).select("dataset", "model", *both(6))


@query(
    "a8_distribution",
    over_runs(
        """SELECT library, count(*) AS n_inside, snap(min(RMSE), 4) AS low, snap(any_value(q1), 4) AS q1, snap(any_value(md), 4) AS median, snap(any_value(q3), 4) AS q3, snap(max(RMSE), 4) AS high
FROM r JOIN b USING (library) WHERE RMSE BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY library""",
        f"r AS (SELECT * FROM runs WHERE {REG})",
        "b AS (SELECT library, quantile_cont(RMSE, 0.25) AS q1, quantile_cont(RMSE, 0.5) AS md, quantile_cont(RMSE, 0.75) AS q3 FROM r GROUP BY library)",
    ),
)
def a8_distribution(spark, d):
    rows = reg(runs(spark, d))
    out = cmp.distribution(rows, "RMSE", ["library"])
    return out.select("library", "n_inside", *[snap(c, 4).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query(
    "a9_distinct_counts",
    over_runs("SELECT track, count(*) AS n_rows, count(DISTINCT model) AS n_models, count(DISTINCT dataset) AS n_datasets, count(DISTINCT model || '|' || dataset) AS n_pairs FROM runs GROUP BY track"),
)
def a9_distinct_counts(spark, d):
    return runs(spark, d).groupBy("track").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("model").alias("n_models"), F.countDistinct("dataset").alias("n_datasets"),
        F.countDistinct("model", "dataset").alias("n_pairs"),
    )


@query("a11_cumulative_time", over_runs("SELECT library, track, model, dataset, step, sum(time_s) OVER (PARTITION BY library, track, model, dataset ORDER BY step) AS total_time FROM runs"))
def a11_cumulative_time(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy(*cmp.RUN).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return runs(spark, d).select(*cmp.RUN, "step", F.sum("time_s").over(w).alias("total_time"))


BEST_METRICS = ["RMSE", "MAE", "time_s", "memory_mb", "R2"]


def best_all_sql(metrics, where):
    parts = " UNION ALL ".join(f"SELECT dataset, library, model, '{m}' AS metric, {m} AS value FROM runs WHERE {where} AND {m} IS NOT NULL" for m in metrics)
    small = ", ".join(f"'{m}'" for m in sorted(cmp.SMALLER_IS_BETTER))
    return f"""SELECT metric, dataset, library, model, snap(value, 6) AS value FROM (
  SELECT *, rank() OVER (PARTITION BY metric, dataset ORDER BY ((CASE WHEN metric IN ({small}) THEN 1 ELSE -1 END) * value)::REAL) AS r
  FROM (SELECT metric, dataset, library, model, avg(value) AS value FROM ({parts}) GROUP BY ALL)) WHERE r = 1"""


@query("a12_leaderboard", over_runs(best_all_sql(["Accuracy", "MacroF1", "time_s", "memory_mb"], MULTI)))
def a12_leaderboard(spark, d):
    out = cmp.best_for_all(multi(runs(spark, d)), ["Accuracy", "MacroF1", "time_s", "memory_mb"])
    return out.select("metric", "dataset", "library", "model", snap("value", 6).alias("value"))


# ---------------------------------------------------------------- windows, sorts, sets


@query("w2_last_checkpoints", over_runs("SELECT library, track, model, dataset, step FROM runs QUALIFY row_number() OVER (PARTITION BY library, track, model, dataset ORDER BY step DESC) <= 5"))
def w2_last_checkpoints(spark, d):
    return cmp.last_checkpoints(runs(spark, d), 5).select(*cmp.RUN, "step")


def best_sql(metric, where, direction):
    return f"""SELECT dataset, library, model, snap(v, 6) AS {metric.lower()} FROM (
  SELECT *, rank() OVER (PARTITION BY dataset ORDER BY v::REAL {direction}) AS r FROM (
    SELECT dataset, library, model, avg({metric}) AS v FROM runs WHERE {where} AND {metric} IS NOT NULL GROUP BY ALL)) WHERE r = 1"""


@query("w3_best_min", over_runs(best_sql("RMSE", REG, "ASC")))
def w3_best_min(spark, d):
    return cmp.best_per_dataset(reg(runs(spark, d)), "RMSE").select("dataset", "library", "model", snap("RMSE", 6).alias("rmse"))


@query("w3_best_max", over_runs(best_sql("Accuracy", MULTI, "DESC")))
def w3_best_max(spark, d):
    return cmp.best_per_dataset(multi(runs(spark, d)), "Accuracy").select("dataset", "library", "model", snap("Accuracy", 6).alias("accuracy"))


@query("w4_last_value", over_runs("SELECT library, track, model, dataset, arg_max(time_s, step) AS time_s, arg_max(valid_updates, step) AS valid_updates FROM runs GROUP BY ALL"))
def w4_last_value(spark, d):
    return runs(spark, d).groupBy(*cmp.RUN).agg(F.max_by("time_s", "step").alias("time_s"), F.max_by("valid_updates", "step").alias("valid_updates"))


def metric_by_model_sql(metric, where, digits=6, limit=""):
    return f"""SELECT model, {both_sql(digits)}, row_number() OVER (ORDER BY {order_sql('model')}) AS position
FROM ({pivot_sql(f"(SELECT * FROM fin WHERE {where} AND {metric} IS NOT NULL)", 'model', metric)}) ORDER BY position {limit}"""


@query("t1_sorted_models", over_final(metric_by_model_sql("time_s", "track IS NOT NULL", 4)))
def t1_sorted_models(spark, d):
    return cmp.metric_by_model(final(spark, d), "time_s").select("model", *both(4), "position")


@query("t2_top_20", over_final(metric_by_model_sql("memory_mb", "track IS NOT NULL", 9, "LIMIT 20")))
def t2_top_20(spark, d):
    """Top 20 is the report."""
    wide = cmp.by_library(final(spark, d), "memory_mb", ["model"])
    return cmp.ordered(wide, ["model"], limit=20).select("model", *both(9), "position")


@query("t3_sorted_names", over_runs("SELECT track, dataset, CAST(row_number() OVER (PARTITION BY track ORDER BY dataset) AS INTEGER) AS position FROM (SELECT DISTINCT track, dataset FROM runs)"))
def t3_sorted_names(spark, d):
    names = runs(spark, d).groupBy("track").agg(F.array_sort(F.collect_set("dataset")).alias("names"))
    out = names.select("track", F.posexplode("names").alias("p", "dataset"))
    return out.select("track", "dataset", (F.col("p") + 1).alias("position"))


def _sides(spark, d, task="Regression"):
    rows = runs(spark, d).filter(F.col("track") == task)
    return {lib: rows.filter(F.col("library") == lib).drop("library") for lib in LIBRARIES}


@query("u1_union_all", over_runs(f"SELECT library, track, model, dataset, step, snap(RMSE, 4) AS rmse FROM runs WHERE {REG}"))
def u1_union_all(spark, d):
    sides = [df.withColumn("library", F.lit(lib)) for lib, df in _sides(spark, d).items()]
    return sides[0].unionByName(sides[1]).select(*cmp.RUN, "step", snap("RMSE", 4).alias("rmse"))


@query("u2_union_missing_columns", over_runs(f"SELECT model, dataset, step, CASE WHEN library = '{A}' THEN snap(MAE, 4) END AS mae, CASE WHEN library = '{B}' THEN snap(RMSE, 4) END AS rmse FROM runs WHERE {REG}"))
def u2_union_missing_columns(spark, d):
    s = _sides(spark, d)
    left = s[A].select("model", "dataset", "step", snap("MAE", 4).alias("mae"))
    right = s[B].select("model", "dataset", "step", snap("RMSE", 4).alias("rmse"))
    return left.unionByName(right, allowMissingColumns=True)


COMMON_ORDER = ["Accuracy", "MAE", "RMSE", "F1", "MicroF1", "MacroF1", "Precision", "Recall"]
COMMON_SQL = " UNION ALL ".join(
    f"SELECT track, '{m}' AS metric, {i} AS position FROM runs WHERE {QUALITY_SQL[m]} IS NOT NULL AND NOT ({MULTI} AND '{m}' = 'F1') GROUP BY track HAVING count(DISTINCT library) = 2"
    for i, m in enumerate(COMMON_ORDER)
)


@query("u3_common_metrics", over_runs(COMMON_SQL))
def u3_common_metrics(spark, d):
    long = runs(spark, d).unpivot(["library", "track"], COMMON_ORDER, "metric", "value").filter(F.col("value").isNotNull())
    sides = [long.filter(F.col("library") == lib).select("track", "metric") for lib in LIBRARIES]
    common = sides[0].intersect(sides[1])
    common = common.filter(~((F.col("track") == "Multiclass classification") & (F.col("metric") == "F1")))
    return common.withColumn("position", (F.array_position(F.array(*[F.lit(m) for m in COMMON_ORDER]), F.col("metric")) - 1).cast("int"))


@query("u4_distinct_union", over_runs("SELECT DISTINCT dataset FROM runs"))
def u4_distinct_union(spark, d):
    a, b = _sides(spark, d, "Multiclass classification").values()
    return a.select("dataset").union(b.select("dataset")).union(reg(runs(spark, d)).select("dataset")).distinct()


@query(
    "u5_merged_banks",
    over_runs(
        f"""SELECT track, model, CASE WHEN bool_or(library = '{B}') THEN '{B}' WHEN bool_or(library = '{A}') THEN '{A}' ELSE 'default' END AS source
FROM (SELECT track, model, library FROM runs UNION ALL SELECT DISTINCT track, '[baseline] Last Class', 'default' FROM runs) GROUP BY track, model"""
    ),
)
def u5_merged_banks(spark, d):
    rows = runs(spark, d).select("track", "model", F.col("library").alias("source")).distinct()
    left, right = (rows.filter(F.col("source") == lib) for lib in LIBRARIES)
    bank = cmp.merged_banks(left, right, ["track", "model"])
    default = rows.select("track").distinct().select("track", F.lit("[baseline] Last Class").alias("model"), F.lit("default").alias("source"))
    return cmp.merged_banks(default, bank, ["track", "model"])


# ---------------------------------------------------------------- joins


@query("j1_attach_r2", over_runs(f"SELECT library, model, dataset, step, snap(RMSE, 4) AS rmse, snap(R2, 6) AS r2 FROM runs WHERE {REG}"))
def j1_attach_r2(spark, d):
    rows = reg(runs(spark, d))
    out = cmp.with_r2(rows.drop("R2"), rows)
    return out.select("library", "model", "dataset", "step", snap("RMSE", 4).alias("rmse"), snap("R2", 6).alias("r2"))


@query(
    "j1_attach_r2_fan_out",
    over_runs(f"""SELECT a.model, a.dataset, a.library, count(*) AS n_rows, snap(avg(b.R2), 6) AS r2 FROM (SELECT * FROM runs WHERE {REG}) a
LEFT JOIN (SELECT * FROM runs WHERE {REG}) b ON a.model = b.model AND a.dataset = b.dataset GROUP BY ALL"""),
)
def j1_attach_r2_fan_out(spark, d):
    rows = reg(runs(spark, d))
    out = cmp.with_r2(rows.drop("R2"), rows, fan_out=True)
    return out.groupBy("model", "dataset", "library").agg(F.count(F.lit(1)).alias("n_rows"), snap(F.avg("R2"), 6).alias("r2"))


PLAN_SQL = "SELECT m.track, m.model, x.library, x.dataset FROM (SELECT DISTINCT track, model FROM runs) m JOIN (SELECT DISTINCT track, library, dataset FROM runs) x USING (track)"


def plan(spark, d):
    rows = runs(spark, d)
    return cmp.run_plan(rows.select("track", "model").distinct(), rows.select("track", "library", "dataset").distinct())


@query("j3_run_plan", over_runs(PLAN_SQL))
def j3_run_plan(spark, d):
    return plan(spark, d).select("track", "model", "library", "dataset")


@query(
    "j5_library_duel",
    over_final(
        f"""SELECT dataset, model, {both_sql(4)}, snap(difference, 4) AS difference,
CASE WHEN "{A}" IS NULL OR "{B}" IS NULL THEN 'only one' WHEN "{A}"::REAL = "{B}"::REAL THEN 'tie' WHEN "{A}" < "{B}" THEN '{A}' ELSE '{B}' END AS winner
FROM (SELECT *, "{A}" - "{B}" AS difference FROM ({pivot_sql(f"(SELECT * FROM fin WHERE {REG})", 'dataset, model', 'RMSE')}))"""
    ),
)
def j5_library_duel(spark, d):
    out = cmp.library_duel(reg(final(spark, d)), "RMSE")
    return out.select("dataset", "model", *both(4), snap("difference", 4).alias("difference"), "winner")


@query("j6_without_result", over_runs(f"SELECT * FROM ({PLAN_SQL}) p WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.track = p.track AND r.model = p.model AND r.library = p.library AND r.dataset = p.dataset)"))
def j6_without_result(spark, d):
    return cmp.without_result(plan(spark, d), runs(spark, d), cmp.RUN).select("track", "model", "library", "dataset")


# ---------------------------------------------------------------- filters and names


@query("f1_one_dataset", over_runs("SELECT library, track, model, step, snap(Accuracy, 6) AS accuracy FROM runs WHERE lower(dataset) = 'events' AND Accuracy IS NOT NULL"))
def f1_one_dataset(spark, d):
    rows = runs(spark, d).filter((normal_name(F.col("dataset")) == "Events".lower()) & F.col("Accuracy").isNotNull())
    return rows.select("library", "track", "model", "step", snap("Accuracy", 6).alias("accuracy"))


ALLOWED_SQL = " OR ".join(f"(library = '{lib}' AND model IN ({', '.join(repr(m) for m in ms)}))" for lib, ms in MULTICLASS_MODELS.items())


@query("f2_allowed_models", over_runs(f"SELECT library, model, dataset, step FROM runs WHERE {MULTI} AND ({ALLOWED_SQL})"))
def f2_allowed_models(spark, d):
    rows = cmp.normalised_runs(multi(runs(spark, d)))
    return cmp.allowed_multiclass(rows).select("library", "model", "dataset", "step")


@query("f4_drop_missing", over_final(f"SELECT track, model, {both_sql(4)} FROM ({pivot_sql('fin', 'track, model', 'RMSE')}) WHERE \"{A}\" IS NOT NULL OR \"{B}\" IS NOT NULL"))
def f4_drop_missing(spark, d):
    wide = cmp.by_library(final(spark, d), "RMSE", ["track", "model"]).dropna(how="all", subset=LIBRARIES)
    return wide.select("track", "model", *both(4))


@query("f6_skipped_tasks", over_runs(f"SELECT * FROM ({PLAN_SQL}) WHERE track NOT IN ('Regression', 'Binary classification')"))
def f6_skipped_tasks(spark, d):
    return plan(spark, d).filter(~F.col("track").isin("Regression", "Binary classification")).select("track", "model", "library", "dataset")


@query("f8_zero_metric", over_runs("SELECT DISTINCT model FROM runs WHERE F1 = 0"))
def f8_zero_metric(spark, d):
    return runs(spark, d).filter(F.col("F1") == 0).select("model").distinct()


@query("p11_dataset_names", over_runs("SELECT DISTINCT track, dataset AS dataset_key, CASE dataset WHEN 'orders' THEN 'Orders' ELSE dataset END AS shown FROM runs"))
def p11_dataset_names(spark, d):
    raw = runs(spark, d).select("track", F.concat(F.lit(" "), F.initcap("dataset"), F.lit("  ")).alias("dataset"))
    key = normal_name(F.col("dataset"))
    return raw.select("track", key.alias("dataset_key"), looked_up(key, {"orders": "Orders"}).alias("shown")).distinct()


@query(
    "p12_model_names",
    over_runs(f"SELECT DISTINCT library, model, CASE WHEN library = '{A}' THEN CASE model " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in MODEL_NAMES.items()) + " WHEN 'TargetMean' THEN '[baseline] Mean predictor' ELSE model END ELSE model END AS model_normalized FROM runs"),
)
def p12_model_names(spark, d):
    names = spark.createDataFrame([*MODEL_NAMES.items(), ("TargetMean", "[baseline] Mean predictor")], "model string, common string")
    names = names.withColumn("library", F.lit(A))
    out = runs(spark, d).select("library", "model").distinct().join(F.broadcast(names), ["library", "model"], "left")
    return out.select("library", "model", F.coalesce("common", "model").alias("model_normalized"))


@query("p13_column_aliases", over_runs("SELECT library, track, model, dataset, step, time_s, snap(memory_mb, 9) AS memory_mb FROM runs"))
def p13_column_aliases(spark, d):
    raw = runs(spark, d).withColumnRenamed("time_s", "elapsed_s").withColumnRenamed("memory_mb", "RSS_MB")
    out = first_alias(first_alias(raw, files.TIME_NAMES, "time_s"), files.MEMORY_NAMES, "memory_mb")
    return out.select(*cmp.RUN, "step", "time_s", snap("memory_mb", 9).alias("memory_mb"))


@query("p14_ensure_columns", over_runs("SELECT library, model, dataset, step, TRY_CAST(model AS DOUBLE) AS model_no, CAST(NULL AS DOUBLE) AS kappa, snap(MAE, 4) AS mae FROM runs"))
def p14_ensure_columns(spark, d):
    text = runs(spark, d).withColumn("MAE", F.col("MAE").cast("string")).withColumn("model_no", F.col("model"))
    out = ensure_columns(text, ["MAE", "model_no", "kappa"])
    return out.select("library", "model", "dataset", "step", "model_no", "kappa", snap("MAE", 4).alias("mae"))


@query("p16_metric_alias", over_runs("SELECT library, model, dataset, step, snap(Accuracy, 6) AS acc, snap(MacroF1, 6) AS macro_f1, time_s AS runtime FROM runs WHERE Accuracy IS NOT NULL"))
def p16_metric_alias(spark, d):
    rows = runs(spark, d).filter(F.col(cmp.metric_column("acc")).isNotNull())
    return rows.select(
        "library", "model", "dataset", "step", snap(cmp.metric_column("acc"), 6).alias("acc"),
        snap(cmp.metric_column("macro_f1"), 6).alias("macro_f1"), F.col(METRIC_ALIASES["runtime"]).alias("runtime"),
    )


@query("p16_f1_fallback", over_runs("SELECT library, track, model, dataset, step, snap(coalesce(F1, MacroF1, MicroF1), 6) AS f1 FROM runs"))
def p16_f1_fallback(spark, d):
    rows = runs(spark, d)
    return rows.select("library", "track", "model", "dataset", "step", snap(cmp.metric_value(rows, "f1"), 6).alias("f1"))


@query(
    "p17_shown_numbers",
    over_final("SELECT library, track, model, dataset, coalesce(printf('%.4f', snap(Accuracy, 6)), 'N/A') AS accuracy, coalesce(printf('%.2f', time_s), 'N/A') AS time_s FROM fin"),
)
def p17_shown_numbers(spark, d):
    out = final(spark, d).withColumn("Accuracy", snap("Accuracy", 6))
    return cmp.summary_text(out, ["Accuracy"]).select(*cmp.RUN, F.col("Accuracy").alias("accuracy"), "time_s")


# ---------------------------------------------------------------- sinks of runs


@query("s6_checkpoint_sink", over_runs(f"SELECT library, model, dataset, step, snap(MAE, 4) AS mae, CASE WHEN library = '{A}' THEN valid_updates END AS valid_updates FROM runs WHERE {REG}"))
def s6_checkpoint_sink(spark, d):
    path = scratch_path(spark, "checkpoints")
    s = _sides(spark, d)
    files.append_checkpoints(s[B].withColumn("library", F.lit(B)).drop("valid_updates"), path, append=False)
    files.append_checkpoints(s[A].withColumn("library", F.lit(A)), path, append=True)
    return files.read_checkpoints(spark, path).select("library", "model", "dataset", "step", snap("MAE", 4).alias("mae"), "valid_updates")


@query(
    "s7_load_results",
    over_runs("""SELECT library, CASE track WHEN 'Regression' THEN 'Regression' WHEN 'Multiclass classification' THEN 'Multiclass Classification' ELSE 'Binary Classification' END AS task,
  count(*) AS n_rows, sum(time_s) AS time_s, snap(sum(memory_mb), 6) AS memory_mb, sum(valid_updates)::BIGINT AS valid_updates FROM runs GROUP BY ALL"""),
)
def s7_load_results(spark, d):
    base = scratch_path(spark, "results")
    paths = []
    for task in DATASETS:
        for lib in LIBRARIES:
            stem = ("capymoa_" if lib == A else "") + task.lower().replace(" ", "_")
            df = runs(spark, d).filter((F.col("track") == task) & (F.col("library") == lib)).drop("library")
            df = df.withColumnRenamed("time_s", "Time in s").withColumnRenamed("memory_mb", "Memory in Mb").withColumnRenamed("valid_updates", "Valid updates")
            df.write.option("header", True).csv(f"{base}/{stem}.csv")
            paths.append(f"{base}/{stem}.csv")
    out = files.load_results(spark, paths)
    return out.groupBy("library", "task").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("time_s").alias("time_s"), snap(F.sum("memory_mb"), 6).alias("memory_mb"),
        F.sum("valid_updates").cast("long").alias("valid_updates"),
    )


@query("s8_summary_sink", over_final("SELECT library, track, model, dataset, snap(Accuracy, 6) AS accuracy, snap(MAE, 4) AS mae, time_s FROM fin"))
def s8_summary_sink(spark, d):
    path = scratch_path(spark, "summary")
    cmp.summary(final(spark, d), ["Accuracy", "MAE"]).write.partitionBy("track").parquet(path)
    return spark.read.parquet(path).select(*cmp.RUN, snap("Accuracy", 6).alias("accuracy"), snap("MAE", 4).alias("mae"), "time_s")


@query(
    "s9_run_catalogue",
    over_runs("""SELECT track, 'Dataset' AS kind, dataset AS name, CAST(max(step) AS VARCHAR) || ' rows' AS spec FROM runs GROUP BY ALL
UNION ALL SELECT track, 'Model', model, string_agg(DISTINCT library, ',' ORDER BY library) FROM runs GROUP BY ALL"""),
)
def s9_run_catalogue(spark, d):
    rows = runs(spark, d)
    sets = rows.groupBy("track", F.col("dataset").alias("name")).agg(F.concat(F.max("step").cast("string"), F.lit(" rows")).alias("spec"))
    models = rows.groupBy("track", F.col("model").alias("name")).agg(F.concat_ws(",", F.array_sort(F.collect_set("library"))).alias("spec"))
    cols = lambda df, kind: df.select("track", F.lit(kind).alias("kind"), "name", "spec")
    return cols(sets, "Dataset").unionByName(cols(models, "Model"))


# ---------------------------------------------------------------- report frames


@query(
    "c1_comparison",
    over_final(
        f"SELECT track, model, metric, {both_sql(4)} FROM ({pivot_sql('good', 'track, model, metric', 'value')})",
        "long AS (" + " UNION ALL ".join(
            f"SELECT library, track, model, '{m}' AS metric, {c} AS value FROM fin WHERE {c} IS NOT NULL AND (NOT {MULTI} OR ({ALLOWED_SQL})) AND NOT ({MULTI} AND '{m}' = 'F1')"
            for m, c in QUALITY_SQL.items()
        ) + ")",
        "good AS (SELECT * FROM long WHERE (track, metric) IN (SELECT (track, metric) FROM long GROUP BY track, metric HAVING count(DISTINCT library) = 2))",
    ),
)
def c1_comparison(spark, d):
    return cmp.comparison(runs(spark, d)).select("track", "model", "metric", *both(4))


@query("c2_metric_by_model", over_final(metric_by_model_sql("Accuracy", MULTI)))
def c2_metric_by_model(spark, d):
    return cmp.metric_by_model(multi(final(spark, d)), "Accuracy").select("model", *both(6), "position")


@query(
    "c3_metric_distribution",
    over_final(
        """SELECT library, count(*) AS n_inside, snap(min(Accuracy), 6) AS low, snap(any_value(q1), 6) AS q1, snap(any_value(md), 6) AS median, snap(any_value(q3), 6) AS q3, snap(max(Accuracy), 6) AS high
FROM r JOIN b USING (library) WHERE Accuracy BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY library""",
        "r AS (SELECT * FROM fin WHERE Accuracy IS NOT NULL)",
        "b AS (SELECT library, quantile_cont(Accuracy, 0.25) AS q1, quantile_cont(Accuracy, 0.5) AS md, quantile_cont(Accuracy, 0.75) AS q3 FROM r GROUP BY library)",
    ),
)
def c3_metric_distribution(spark, d):
    out = cmp.distribution(final(spark, d), "Accuracy", ["library"])
    return out.select("library", "n_inside", *[snap(c, 6).alias(c) for c in ("low", "q1", "median", "q3", "high")])


@query("c4_evolution_by_dataset", over_runs(f"SELECT dataset, library, step, snap(avg(MacroF1), 6) AS macro FROM runs WHERE {MULTI} GROUP BY ALL"))
def c4_evolution_by_dataset(spark, d):
    return cmp.evolution(multi(runs(spark, d)), "MacroF1", ["dataset"]).select("dataset", "library", "step", snap("MacroF1", 6).alias("macro"))


@query("c5_time_by_model", over_final(metric_by_model_sql("time_s", REG, 4, "LIMIT 20")))
def c5_time_by_model(spark, d):
    wide = cmp.by_library(reg(final(spark, d)), "time_s", ["model"])
    return cmp.ordered(wide, ["model"], limit=20).select("model", *both(4), "position")


@query("c5_memory_by_model", over_final(metric_by_model_sql("memory_mb", MULTI, 9, "LIMIT 20")))
def c5_memory_by_model(spark, d):
    wide = cmp.by_library(multi(final(spark, d)), "memory_mb", ["model"])
    return cmp.ordered(wide, ["model"], limit=20).select("model", *both(9), "position")


@query("c6_time_by_dataset", over_final(f"SELECT dataset, model, {both_sql(4)} FROM ({pivot_sql('fin', 'dataset, model', 'time_s')})"))
def c6_time_by_dataset(spark, d):
    return cmp.by_library(final(spark, d), "time_s", ["dataset", "model"]).select("dataset", "model", *both(4))


@query("c6_memory_by_dataset", over_final(f"SELECT dataset, model, {both_sql(9)} FROM ({pivot_sql('fin', 'dataset, model', 'memory_mb')})"))
def c6_memory_by_dataset(spark, d):
    return cmp.by_library(final(spark, d), "memory_mb", ["dataset", "model"]).select("dataset", "model", *both(9))


@query("c7_summary", over_final("SELECT library, track, model, dataset, snap(Accuracy, 6) AS accuracy, snap(F1, 6) AS f1, snap(MAE, 4) AS mae, snap(RMSE, 4) AS rmse, time_s, snap(memory_mb, 9) AS memory_mb FROM fin"))
def c7_summary(spark, d):
    out = cmp.summary(final(spark, d), ["Accuracy", "F1", "MAE", "RMSE"])
    return out.select(
        *cmp.RUN, snap("Accuracy", 6).alias("accuracy"), snap("F1", 6).alias("f1"), snap("MAE", 4).alias("mae"), snap("RMSE", 4).alias("rmse"),
        "time_s", snap("memory_mb", 9).alias("memory_mb"),
    )


@query("c8_heat_map", over_final(f"SELECT model, metric, {MINMAX_SQL} FROM ({pivot_sql('long', 'model, metric', 'value')})", LONG_SQL))
def c8_heat_map(spark, d):
    return cmp.heat_map(multi(final(spark, d)), HEAT_METRICS).select("model", "metric", *both(6))


def _long_sql(track, metrics):
    cols = ", ".join(f"snap({QUALITY_SQL[m]}, 4) AS {m.lower()}_" for m in metrics)
    return over_runs(f"SELECT library, track, model, lower(trim(dataset)) AS dataset, step, {cols}, snap(memory_mb, 9) AS memory_mb, time_s FROM runs WHERE track = '{track}'")


def _long(track, metrics):
    def run(spark, d):
        out = cmp.long_frame(_sides(spark, d, track), metrics)
        return out.select(*cmp.RUN, "step", *[snap(m, 4).alias(f"{m.lower()}_") for m in metrics], snap("memory_mb", 9).alias("memory_mb"), "time_s")

    return run


for _name, _track, _metrics in (
    ("c9_long_regression", "Regression", ["MAE", "RMSE"]),
    ("c9_long_multiclass", "Multiclass classification", ["Accuracy", "F1", "MicroF1", "MacroF1"]),
    ("c9_long_binary", "Binary classification", ["Accuracy", "Precision", "Recall", "F1"]),
):
    query(_name, _long_sql(_track, _metrics))(_long(_track, _metrics))


@query("c10_bars", over_runs(f"SELECT model, {both_sql(4)} FROM ({pivot_sql(f'''(SELECT * FROM runs WHERE {REG} AND dataset = 'orders')''', 'model', 'RMSE')})"))
def c10_bars(spark, d):
    rows = cmp.long_frame(_sides(spark, d), ["MAE", "RMSE"]).filter(F.col("dataset") == "orders")
    return cmp.by_library(rows, "RMSE", ["model"]).select("model", *both(4))


@query("c11_best_regression", over_runs(best_all_sql(BEST_METRICS, REG)))
def c11_best_regression(spark, d):
    out = cmp.best_for_all(reg(runs(spark, d)), BEST_METRICS)
    return out.select("metric", "dataset", "library", "model", snap("value", 6).alias("value"))


@query("c11_best_binary", over_runs(best_all_sql(["Accuracy", "F1", "Recall", "time_s", "memory_mb"], "track = 'Binary classification'")))
def c11_best_binary(spark, d):
    rows = runs(spark, d).filter(F.col("track") == "Binary classification")
    out = cmp.best_for_all(rows, ["Accuracy", "F1", "Recall", "time_s", "memory_mb"])
    return out.select("metric", "dataset", "library", "model", snap("value", 6).alias("value"))



# ---------------------------------------------------------------- anomaly track


def _anomaly_sql(library):
    rule = RULES[library]
    scores = "anp AS (" + " UNION ALL ".join(
        f"SELECT {c}.step, is_high AS y, '{m}' AS model, CAST({score} > 0.5 AS INTEGER) AS pred FROM {src}"
        for m, c, score, src in (
            ("gaussian", "ga", "score", "ga"), ("deviation", "mo", "coalesce(abs(value - m) / (sd + 1e-10), 0.0)", "mo"),
            ("predictive", "pr", "score", "pr JOIN ev USING (step)"),
        )
    ).replace("pr.step", "step") + ")"
    body = sql.with_(EV, sql.sized("ev", rule), MOMENTS, GAUSS, sql.regressors("ev", "value"), PREDICTIVE, scores, sql.classification_checkpoints("anp", rule))
    shown = " ".join(f"WHEN '{m}' THEN '{name}'" for m, (name, _, _) in SCORERS.items())
    size = " ".join(f"WHEN '{m}' THEN {n}" for m, (_, n, _) in SCORERS.items())
    return f"""SELECT * FROM ({body}
SELECT '{library}' AS library, 'Anomaly detection' AS track, CASE model {shown} END AS model, 'events' AS dataset, ck.step,
  accuracy AS Accuracy, prec AS Precision_, recall AS Recall, f1 AS F1, (CASE model {size} END) * 8 / 1048576.0::DOUBLE AS memory_mb,
  abs(floor(epoch(s.ts)) - (SELECT floor(epoch(ts)) FROM ev WHERE step = 1)) AS time_s
FROM ck JOIN ev s ON s.step = ck.step)"""


ANOMALY_RUNS = "runs AS (\n" + "\nUNION ALL\n".join(_anomaly_sql(lib) for lib in RULES) + ")"
ANOMALY_METRICS = ["Accuracy", "Precision", "Recall", "F1"]


@query(
    "c9_long_anomaly",
    sql.with_(ANOMALY_RUNS)
    + "SELECT library, track, model, dataset, step, " + ", ".join(f"snap({QUALITY_SQL[m]}, 4) AS {m.lower()}_" for m in ANOMALY_METRICS)
    + ", snap(memory_mb, 9) AS memory_mb, time_s FROM runs",
)
def c9_long_anomaly(spark, d):
    rows = anomaly_runs(spark, d)
    out = cmp.long_frame({lib: rows.filter(F.col("library") == lib).drop("library") for lib in LIBRARIES}, ANOMALY_METRICS)
    return out.select(*cmp.RUN, "step", *[snap(m, 4).alias(f"{m.lower()}_") for m in ANOMALY_METRICS], snap("memory_mb", 9).alias("memory_mb"), "time_s")


@query("c11_best_anomaly", sql.with_(ANOMALY_RUNS) + best_all_sql(["Accuracy", "F1", "Recall", "time_s", "memory_mb"], "true"))
def c11_best_anomaly(spark, d):
    out = cmp.best_for_all(anomaly_runs(spark, d), ["Accuracy", "F1", "Recall", "time_s", "memory_mb"])
    return out.select("metric", "dataset", "library", "model", snap("value", 6).alias("value"))
