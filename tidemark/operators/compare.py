"""Comparison of runs: final metrics, leaderboards, pivots, rankings and chart-ready frames.

Inputs are checkpoint tables (``library, track, model, dataset, step``, metric columns, ``memory_mb``,
``time_s``). They are aggregates, about 50 rows per run, so windows per run or per dataset are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import DATASET_NAMES, LIBRARIES, METRIC_ALIASES, MODEL_NAMES, MULTICLASS_MODELS
from tidemark.functions.columns import shown
from tidemark.operators.prepare import ensure_columns, looked_up, normal_name

RUN = ["library", "track", "model", "dataset"]
QUALITY = ["Accuracy", "Precision", "Recall", "F1", "MicroF1", "MacroF1", "MAE", "RMSE"]
LAST = ["step", "memory_mb", "time_s", "valid_updates"]
SMALLER_IS_BETTER = {"MAE", "RMSE", "time_s", "memory_mb"}


def last_checkpoints(runs: DataFrame, n: Column | int, keys: list[str] = RUN) -> DataFrame:
    """The last n checkpoints of every run by step; ``n`` may use the column ``_n`` (checkpoints of the run)."""
    run = Window.partitionBy(*keys)
    out = runs.withColumn("_n", F.count(F.lit(1)).over(run)).withColumn("_r", F.row_number().over(run.orderBy(F.desc("step"))))
    return out.filter(F.col("_r") <= n).drop("_n", "_r")


def final_metrics(runs: DataFrame, keys: list[str] = RUN) -> DataFrame:
    """One row per run: metrics are means over the last tenth of the checkpoints (three at least, missing
    values ignored), everything else is the last value."""
    tail = last_checkpoints(runs, F.greatest(F.lit(3), F.floor(F.col("_n") * 0.1)), keys)
    return tail.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in QUALITY if c in runs.columns],
        *[F.max_by(c, "step").alias(c) for c in LAST if c in runs.columns and c != "step"],
        F.max("step").alias("step"),
    )


def metric_column(name: str) -> str:
    """Column for a metric name or one of its short names."""
    return METRIC_ALIASES.get(name.lower(), name)


def metric_value(df: DataFrame, name: str) -> Column:
    """The metric's value in each row; F1 falls back to its macro and then its micro form where a task has no plain one."""
    wanted = metric_column(name)
    names = [c for c in (["F1", "MacroF1", "MicroF1"] if wanted == "F1" else [wanted]) if c in df.columns]
    return F.coalesce(*names) if names else F.lit(None).cast("double")


def mean_by(df: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(metric).alias(metric))


def by_library(df: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Mean of a metric with one column per library (all libraries listed, so no extra job)."""
    return df.groupBy(*keys).pivot("library", LIBRARIES).agg(F.avg(metric))


def ordered(df: DataFrame, tie: list[str], limit: int | None = None, descending: bool = True) -> DataFrame:
    """Sort a report by the first library, missing last, and number the rows."""
    first, second = F.col(LIBRARIES[0]), F.col(LIBRARIES[1])
    keys = [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in (first, second)]
    out = df.orderBy(*keys, *tie)
    out = out.limit(limit) if limit else out
    return out.withColumn("position", F.row_number().over(Window.orderBy(*keys, *tie)))


def metric_by_model(final: DataFrame, metric: str) -> DataFrame:
    """Mean per model with one column per library, models without any value dropped, best of the first library on top."""
    wide = by_library(final.filter(F.col(metric).isNotNull()), metric, ["model"]).dropna(how="all", subset=LIBRARIES)
    return ordered(wide, ["model"])


def distribution(final: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Quartiles and whiskers (farthest values within 1.5 interquartile ranges of the box)."""
    quartiles = F.percentile(metric, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    box = final.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(quartiles.alias("q"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    rows = final.join(box, keys).filter(F.col(metric).between(F.col("q")[0] - reach, F.col("q")[2] + reach))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_inside"),
        F.min(metric).alias("low"),
        *[F.first(F.col("q")[i]).alias(n) for i, n in enumerate(("q1", "median", "q3"))],
        F.max(metric).alias("high"),
    )


def min_max(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns to 0..1 over the whole table; a column with one value stays as it is."""
    bounds = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).collect()[0]
    scaled = {}
    for c in columns:
        lo, hi = bounds[f"lo_{c}"], bounds[f"hi_{c}"]
        if lo is not None and hi > lo:
            scaled[c] = (F.col(c) - F.lit(lo)) / F.lit(hi - lo)
    return df.withColumns(scaled) if scaled else df


def metric_long(final: DataFrame, metrics: list[str]) -> DataFrame:
    long = final.unpivot(["library", "model"], metrics, "metric", "value")
    return long.filter(F.col("value").isNotNull())


def heat_map(final: DataFrame, metrics: list[str]) -> DataFrame:
    wide = metric_long(final, metrics).groupBy("model", "metric").pivot("library", LIBRARIES).agg(F.avg("value"))
    return min_max(wide, LIBRARIES)


def best_per_dataset(df: DataFrame, metric: str, maximize: bool | None = None) -> DataFrame:
    """Best (library, model) of each dataset; ties share the first rank."""
    if maximize is None:
        maximize = metric not in SMALLER_IS_BETTER
    mean = mean_by(df.filter(F.col(metric).isNotNull()), metric, ["dataset", "library", "model"])
    # ranks are taken in single precision, so that equal runs tie whatever the order of summation
    value = F.col(metric).cast("float")
    rank = F.rank().over(Window.partitionBy("dataset").orderBy(value.desc() if maximize else value.asc()))
    return mean.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def best_for_all(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Best per dataset for every metric in one long table."""
    long = df.unpivot(["dataset", "library", "model"], metrics, "metric", "value").filter(F.col("value").isNotNull())
    mean = long.groupBy("metric", "dataset", "library", "model").agg(F.avg("value").alias("value"))
    sign = F.when(F.col("metric").isin(sorted(SMALLER_IS_BETTER)), F.lit(1.0)).otherwise(F.lit(-1.0))
    rank = F.rank().over(Window.partitionBy("metric", "dataset").orderBy((sign * F.col("value")).cast("float")))
    return mean.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def long_frame(tables: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    """Result tables of the libraries as one long frame: names folded, missing columns NULL, bad numbers NULL."""
    keep = ["step", "track", "model", "dataset", *metrics, "memory_mb", "time_s"]
    out = None
    for library, df in tables.items():
        df = ensure_columns(df, [*metrics, "memory_mb", "time_s"]).withColumn("dataset", normal_name(F.col("dataset")))
        df = df.select(F.lit(library).alias("library"), *keep)
        out = df if out is None else out.unionByName(df)
    return out


def with_r2(df: DataFrame, r2: DataFrame, fan_out: bool = False) -> DataFrame:
    """Attach R2 by run and step; ``fan_out`` joins by (model, dataset) only, which multiplies the rows."""
    keys = ["model", "dataset"] if fan_out else ["library", "model", "dataset", "step"]
    return df.join(r2.select(*keys, "R2"), keys, "left")


def common_model_name(library: Column, model: Column) -> Column:
    return F.when(library == LIBRARIES[0], looked_up(model, MODEL_NAMES)).otherwise(model)


def normalised_runs(runs: DataFrame) -> DataFrame:
    out = runs.withColumn("dataset", looked_up(F.col("dataset"), DATASET_NAMES))
    return out.withColumn("model_normalized", common_model_name(F.col("library"), F.col("model")))


def allowed_multiclass(runs: DataFrame, name: str = "model_normalized") -> DataFrame:
    """Keep the listed models of the multiclass report; libraries without a list are kept whole."""
    keep = F.lit(True)
    for library, models in MULTICLASS_MODELS.items():
        keep = keep & ((F.col("library") != library) | F.col(name).isin(models))
    return runs.filter(keep)


def library_duel(final: DataFrame, metric: str) -> DataFrame:
    """Both libraries side by side per (dataset, model) with difference and winner."""
    sides = [final.filter(F.col("library") == lib).select("dataset", "model", F.col(metric).alias(lib)) for lib in LIBRARIES]
    out = sides[0].join(sides[1], ["dataset", "model"], "full_outer")
    a, b = F.col(LIBRARIES[0]), F.col(LIBRARIES[1])
    better = a < b if metric in SMALLER_IS_BETTER else a > b
    winner = F.when(a.isNull() | b.isNull(), "only one").when(a.cast("float") == b.cast("float"), "tie").when(better, LIBRARIES[0])
    return out.withColumn("difference", a - b).withColumn("winner", winner.otherwise(LIBRARIES[1]))


def run_plan(models: DataFrame, datasets: DataFrame, keys: list[str] = ["track"]) -> DataFrame:  # noqa: B006
    """Every model with every dataset of its track."""
    return models.join(datasets, keys)


def without_result(plan: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(results.select(*keys).distinct(), keys, "left_anti")


def merged_banks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two model banks; the right one wins on equal keys."""
    both = left.withColumn("_p", F.lit(0)).unionByName(right.withColumn("_p", F.lit(1)))
    rest = [c for c in left.columns if c not in keys]
    return both.groupBy(*keys).agg(*[F.max_by(c, "_p").alias(c) for c in rest])


def summary(final: DataFrame, metrics: list[str]) -> DataFrame:
    return final.select("library", "track", "model", "dataset", *metrics, "time_s", "memory_mb")


def summary_text(final: DataFrame, metrics: list[str]) -> DataFrame:
    """The summary with numbers as text: 4 digits for metrics, 2 for time and memory, N/A if missing."""
    return final.select(
        "library", "track", "model", "dataset", *[shown(F.col(m), 4).alias(m) for m in metrics],
        *[shown(F.col(c), 2).alias(c) for c in ("time_s", "memory_mb")],
    )


def evolution(runs: DataFrame, metric: str, keys: list[str]) -> DataFrame:
    """Mean metric of a library by step, over the models (and datasets, unless they are in ``keys``)."""
    return mean_by(runs.filter(F.col(metric).isNotNull()), metric, [*keys, "library", "step"])


def comparison(runs: DataFrame) -> DataFrame:
    """The whole comparison in one table: names folded, multiclass models filtered, final metrics per run,
    then library means per (track, model, metric) for every metric both libraries report."""
    named = normalised_runs(runs)
    multi = F.col("track") == "Multiclass classification"
    kept = named.filter(~multi).unionByName(allowed_multiclass(named.filter(multi)))
    final = final_metrics(kept)
    metrics = [m for m in QUALITY if m in runs.columns]
    long = final.unpivot(["library", "track", "model"], metrics, "metric", "value").filter(F.col("value").isNotNull())
    both = Window.partitionBy("track", "metric")
    n_lib = F.size(F.collect_set("library").over(both))
    wide = long.withColumn("_libs", n_lib).filter((F.col("_libs") >= 2) & ~((F.col("track") == "Multiclass classification") & (F.col("metric") == "F1")))
    return wide.groupBy("track", "model", "metric").pivot("library", LIBRARIES).agg(F.avg("value"))
