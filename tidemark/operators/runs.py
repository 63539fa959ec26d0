"""Benchmark runs: every (library, model, dataset) with its checkpoint rows.

Two result families are produced, one per checkpoint rule, under the library labels that result files use.
All models and targets of a stream share one scan, whose rows are counted once in the blocks of both rules; a family only differs in
where its checkpoints fall.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import LIBRARIES
from tidemark.operators import anomaly
from tidemark.operators.baselines import baseline_regressors, class_list, shared_baselines
from tidemark.operators.metrics import confusion_checkpoints, error_checkpoints, error_sums, regression_checkpoints
from tidemark.plans.checkpoints import block, checkpoint_steps, interval, reported
from tidemark.plans.stream import Stream
from tidemark.session import written
from tidemark.sources.tables import stream, target_stream

RULES = dict(zip(LIBRARIES, ("ceil", "floor")))
# Model names under which the two libraries report the same baselines.
SHOWN_AS = {
    "CapyMOA": {"mean": "TargetMean", "no_change": "NoChange", "last_class": "[baseline] Last Class", "majority": "MajorityClass"},
    "River": {"mean": "[baseline] Mean predictor", "no_change": "NoChange", "last_class": "[baseline] Last Class", "majority": "MajorityClass"},
}
DATASETS = {
    "Regression": {"orders": ("ord_reg", "o_orderdate"), "events": ("ev_reg", "ts")},
    "Multiclass classification": {"orders": ("ord_multi", "o_orderdate"), "events": ("ev_multi", "ts")},
    "Binary classification": {"events": ("ev_bin", "ts")},
}
POSITIVE = {"ord_multi": "F", "ev_multi": "error", "ev_bin": "1"}
METRICS = ["Accuracy", "Precision", "Recall", "F1", "MicroF1", "MacroF1", "MAE", "RMSE", "R2"]
REGRESSORS, CLASSIFIERS = ["mean", "no_change"], ["last_class", "majority"]
BYTES_PER_MB = 1024.0 * 1024.0
#: Scorers of the anomaly track: shown name, numbers kept between two rows, settings.
SCORERS = {
    "gaussian": ("GaussianScorer", 3, {"grace": "100", "threshold": "0.5"}),
    "deviation": ("AbsoluteDeviation", 3, {"threshold": "0.5"}),
    "predictive": ("PredictiveScorer", 5, {"n_std": "3.0", "threshold": "0.5", "model": "mean"}),
}


def state_values(model: str, n_classes: int) -> int:
    """How many numbers a model keeps between two rows."""
    return {"mean": 2, "fading": 2, "no_change": 1, "last_class": 1, "majority": n_classes}[model]


def block_counts(st: Stream, targets: dict[str, tuple[str, list | None]], column: str) -> DataFrame:
    """What the runs of all targets of a stream need, from one scan and one aggregation of its rows.

    One row per checkpoint block (of both rules: ``floor``, ``ceil``) and combination of labels and predicted labels: their number
    ``cnt``, the error sums of the regression targets, the last step and its time, the time of the first row of the stream.
    """
    rows = shared_baselines(st, targets)
    blocks = {rule: block(F.col("step"), interval(st.n, rule)) for rule in RULES.values()}
    at = F.unix_timestamp(F.col(column).cast("timestamp")).cast("double")
    labels, aggs = [], [F.count(F.lit(1)).alias("cnt"), F.max_by(at, "step").alias("last_at"), F.max("step").alias("last_step")]
    aggs.append(F.max(F.when(F.col("step") == 1, at)).alias("first_at"))
    for tag, (y, classes) in targets.items():
        if classes is None:
            aggs.append(F.struct(*error_sums([tag + m for m in REGRESSORS], y)).alias(f"{tag}sums"))
        else:
            labels += [F.col(y).alias(f"{tag}y"), *[F.col(tag + m) for m in CLASSIFIERS]]
    counts = rows.groupBy(*[c.alias(rule) for rule, c in blocks.items()], *labels).agg(*aggs)
    return written(counts, "counts")


def run_checkpoints(counts: DataFrame, tag: str, n: int, task: str, library: str, n_classes: int, positive: str | None) -> DataFrame:
    """Checkpoints of the baselines of one target under the rule of a library, from ``block_counts``."""
    rule = RULES[library]
    if task == "Regression":
        models = REGRESSORS
        sums = [F.sum(f"{tag}sums.{k}_{i}").alias(f"{k}_{i}") for i in range(len(models)) for k in "nasyq"]
        out = error_checkpoints(counts.groupBy(F.col(rule).alias("block")).agg(*sums), n, models, rule)
    else:
        models = CLASSIFIERS
        pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(tag + m).alias("pred")) for m in models]))
        long = counts.select(F.col(rule).alias("block"), F.col(f"{tag}y").alias("y"), "cnt", pairs.alias("p")).select("block", "y", "cnt", "p.*")
        long = long.filter(F.col("y").isNotNull() & F.col("pred").isNotNull())
        out = confusion_checkpoints(long.groupBy("model", "block", "y", "pred").agg(F.sum("cnt").alias("cnt")), n, rule, positive)
    sizes = F.create_map(*[F.lit(x) for m in models for x in (m, state_values(m, n_classes) * 8 / BYTES_PER_MB)])
    return out.withColumn("memory_mb", F.element_at(sizes, F.col("model")))


def block_times(counts: DataFrame, n: int, rule: str) -> DataFrame:
    """Stream time at each checkpoint, as ``clock``, from ``block_counts``."""
    first = counts.agg(F.max("first_at")).collect()[0][0]
    last = counts.groupBy(F.col(rule).alias("block")).agg(F.max_by("last_at", "last_step").alias("at"))
    return reported(last, n, interval(n, rule), rule).select("step", F.abs(F.col("at") - F.lit(first).cast("double")).alias("time_s"))


def clock(st: Stream, column: str, rule: str) -> DataFrame:
    """Stream time at each checkpoint: seconds between the first row and the checkpoint row."""
    at = F.unix_timestamp(F.col(column).cast("timestamp")).cast("double")
    first = st.df.filter(F.col("step") == 1).select(at).collect()[0][0]
    return checkpoint_steps(st.df, st.n, rule).select("step", F.abs(at - F.lit(first)).alias("time_s"))


def dataset_runs(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    """All runs of all tasks of one dataset, as a table. Its rows are scanned once, whatever the number of tasks and libraries."""
    tasks = {task: sets[dataset] for task, sets in DATASETS.items() if dataset in sets}
    streams = {task: target_stream(spark, sf_dir, name) for task, (name, _) in tasks.items()}
    with ThreadPoolExecutor(len(tasks)) as pool:
        classes = dict(zip(streams, pool.map(lambda t: None if t == "Regression" else class_list(streams[t]), streams)))
    st, column = next(iter(streams.values())), next(iter(tasks.values()))[1]
    tags = {task: f"_{i}_" for i, task in enumerate(tasks)}
    counts = block_counts(st, {tags[t]: (streams[t].target, classes[t]) for t in tasks}, column)
    table = None
    for library, rule in RULES.items():
        times = block_times(counts, st.n, rule)
        shown = F.create_map(*[F.lit(x) for pair in SHOWN_AS[library].items() for x in pair])
        for task, (name, _) in tasks.items():
            out = run_checkpoints(counts, tags[task], st.n, task, library, len(classes[task] or []), POSITIVE.get(name))
            part = out.join(F.broadcast(times), "step", "left").select(
                F.lit(library).alias("library"),
                F.lit(task).alias("track"),
                F.element_at(shown, F.col("model")).alias("model"),
                F.lit(dataset).alias("dataset"),
                "step",
                *[F.col(m) if m in out.columns else F.lit(None).cast("double").alias(m) for m in METRICS],
                "valid_updates",
                "memory_mb",
                "time_s",
            )
            table = part if table is None else table.unionByName(part)
    return written(table, "runs")


def build_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all datasets. They do not depend on each other, so their jobs are submitted side by side."""
    datasets = sorted({dataset for sets in DATASETS.values() for dataset in sets})
    with ThreadPoolExecutor(len(datasets)) as pool:
        parts = list(pool.map(lambda d: dataset_runs(spark, sf_dir, d), datasets))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return table


def anomaly_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint rows of the anomaly track: every scorer over the event stream, under both checkpoint rules."""
    st, values = stream(spark, sf_dir, "ev_anom"), stream(spark, sf_dir, "ev_reg")
    scored = {
        "gaussian": anomaly.gaussian_scorer(st, "value"),
        "deviation": anomaly.absolute_deviation(st, "value"),
        "predictive": anomaly.predictive_scorer(values, baseline_regressors(values, ("mean",)), "mean"),
    }
    rows = None
    for m, df in scored.items():
        part = df.select("step", F.lit(m).alias("model"), F.col(st.target), F.col(m).alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    rows = written(rows, "anomaly-scores")
    out = None
    for library, rule in RULES.items():
        times = clock(st, "ts", rule)
        for m, (shown, size, _) in SCORERS.items():
            ck = anomaly.evaluate(rows.where(F.col("model") == m), st.n, "score", st.target, rule=rule).join(times, "step", "left")
            part = ck.select(
                F.lit(library).alias("library"), F.lit("Anomaly detection").alias("track"), F.lit(shown).alias("model"),
                F.lit("events").alias("dataset"), "step", "Accuracy", "Precision", "Recall", "F1", "valid_updates",
                F.lit(size * 8 / BYTES_PER_MB).alias("memory_mb"), "time_s",
            )
            out = part if out is None else out.unionByName(part)
    return out


_runs: dict[tuple, DataFrame] = {}


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checkpoint table of all runs, computed once per session and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _runs:
        _runs[key] = build_runs(spark, sf_dir)
    return _runs[key]


def timed_checkpoints(st: Stream) -> DataFrame:
    """Checkpoints of the baselines with wall time of the job and size of the model state."""
    models = ["mean", "no_change"]
    start = time.perf_counter()
    out = written(regression_checkpoints(baseline_regressors(st, tuple(models)), st.n, models, st.target), "timed")
    elapsed = time.perf_counter() - start
    sizes = F.create_map(*[F.lit(x) for m in models for x in (m, state_values(m, 0) * 8 / BYTES_PER_MB)])
    return out.select(
        "model", "step", "MAE", "RMSE", F.element_at(sizes, F.col("model")).alias("memory_mb"), F.lit(elapsed).alias("time_s")
    )
