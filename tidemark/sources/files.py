"""Labelled datasets, result tables and exports as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.fixed_values import GENERATED_PREFIX, LIBRARIES, LIBRARY_WORD, MEMORY_NAMES, TASK_FOLDERS, TIME_NAMES
from tidemark.functions.columns import number_or_zero
from tidemark.operators.prepare import bounded, first_alias

# task folder and dataset name of a CSV file, or of a part file of a CSV folder
PLACE = r"/([^/]+)/([^/]+)\.csv(?:/[^/]*)?$"


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, target: str = "target") -> DataFrame:
    """A CSV with header; the target column must be there and comes last."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if target not in df.columns:
        raise ValueError(f"{path}: missing target column '{target}'")
    return df.select(*[c for c in df.columns if c != target], target)


def save_labelled(df: DataFrame, path: str, target: str = "target", fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Features first, target last."""
    out = df.select(*[c for c in df.columns if c != target], target)
    out.write.mode(mode).option("header", True).format(fmt).save(path)


def discover(spark: SparkSession, base: str) -> DataFrame:
    """(task, dataset, row, x MAP, target) for every ``base/<task folder>/<dataset>.csv``.

    The folder name gives the task; error files do not match the pattern. Files may have different columns,
    so each line is read against the header of its own file.
    """
    lines = (
        spark.read.text(f"{base}/*/*.csv")
        .withColumn("path", F.col("_metadata.file_path"))
        .withColumn("folder", F.regexp_extract("path", PLACE, 1))
        .withColumn("dataset", F.regexp_extract("path", PLACE, 2))
    )
    tasks = F.create_map(*[F.lit(x) for pair in TASK_FOLDERS.items() for x in pair])
    lines = lines.withColumn("task", F.element_at(tasks, F.col("folder"))).filter(F.col("task").isNotNull())
    # the header is the line that ends with the target name
    is_header = F.col("value").rlike(r"(^|,)target\s*$")
    headers = lines.filter(is_header).groupBy("path").agg(F.first("value").alias("header"))
    # one header a file: lines stay where they are
    rows = lines.filter(~is_header & (F.trim("value") != "")).join(bounded(headers), "path")
    names, cells = F.split("header", ","), F.split("value", ",")
    x = F.map_from_arrays(
        F.slice(names, F.lit(1), F.size(names) - 1), F.transform(F.slice(cells, F.lit(1), F.size(names) - 1), number_or_zero)
    )
    return rows.select("task", "dataset", x.alias("x"), F.element_at(cells, -1).alias("target"))


def positional_rows(lines: DataFrame, n_features: int, text: str = "value") -> DataFrame:
    """Rows by position: blank rows skipped, short rows padded with 0, long rows cut, target = last cell."""
    cells = F.split(F.col(text), ",")
    out = lines.filter(F.trim(text) != "")
    values = F.slice(cells, F.lit(1), F.size(cells) - 1)
    padded = F.slice(F.concat(values, F.array_repeat(F.lit("0"), n_features)), 1, n_features)
    return out.select(
        *[c for c in lines.columns if c != text],
        *[number_or_zero(F.get(padded, i)).alias(f"x{i}") for i in range(n_features)],
        F.element_at(cells, -1).alias("target"),
    )


def library_of(stem: Column) -> Column:
    return F.when(F.lower(stem).contains(LIBRARY_WORD), LIBRARIES[0]).otherwise(LIBRARIES[1])


def task_of(stem: Column) -> Column:
    """Task from a result file name: by pattern, else the name itself in title case."""
    low = F.lower(stem)
    plain = F.regexp_replace(F.regexp_replace(low, f"{LIBRARY_WORD}__", f"{LIBRARY_WORD}_"), f"^{LIBRARY_WORD}_", "")
    return (
        F.when(low.contains("regression"), "Regression")
        .when(low.contains("multiclass"), "Multiclass Classification")
        .when(low.contains("binary") & low.contains("class"), "Binary Classification")
        .when(low.contains("anomaly"), "Anomaly Detection")
        .otherwise(F.initcap(F.regexp_replace(plain, "_", " ")))
    )


def load_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result tables with ``library``, ``task``, ``time_s`` and ``memory_mb``; files with other columns are padded.

    One read per file (there are as many as tasks and libraries), all in one lazy union.
    """
    out = None
    for path in sorted(paths):
        stem = path.rstrip("/").split("/")[-1].removesuffix(".csv")
        if stem.startswith(GENERATED_PREFIX):
            continue
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
        df = first_alias(first_alias(df, TIME_NAMES, "time_s"), MEMORY_NAMES, "memory_mb")
        df = df.drop(*[c for c in (*TIME_NAMES, *MEMORY_NAMES) if c in df.columns and c not in ("time_s", "memory_mb")])
        df = df.withColumnRenamed("Valid updates", "valid_updates")
        df = df.withColumns({"library": library_of(F.lit(stem)), "task": task_of(F.lit(stem))})
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def append_checkpoints(df: DataFrame, path: str, append: bool) -> None:
    """Checkpoint sink: replaces the table, or appends to it with a union of the columns."""
    df.write.mode("append" if append else "overwrite").parquet(path)


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def example_text(label: Column, features: dict[str, Column]) -> Column:
    """``label | name:value name:value`` with labels -1 and 1."""
    pairs = F.concat_ws(" ", *[F.concat(F.lit(f"{k}:"), v.cast("string")) for k, v in features.items()])
    return F.concat((2 * label.cast("int") - 1).cast("string"), F.lit(" | "), pairs)
