"""Stream preparation: encodings, interval labels, sparse features, standardisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import dict_keys, first_true, number_or_null, number_or_zero
from tidemark.plans.order import numbered
from tidemark.plans.prefix import moments
from tidemark.plans.stream import Stream

BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a side for broadcast if it has at most ``limit`` rows; otherwise leave the join to the planner."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def needs_encoding(df: DataFrame, label: str, first: int | None = None) -> DataFrame:
    """Whether any label is not a number. ``first`` looks at so many rows only, as row-by-row loaders do (10)."""
    seen = df if first is None else df.filter(F.col("step") <= first)
    return seen.agg(
        (F.count_if(number_or_null(F.col(label)).isNull()) > 0).alias("needs_encoding")
    )


def label_index(df: DataFrame, label: str, name: str = "label_index") -> DataFrame:
    """Encode labels as 0.. in sorted (bytewise) order, however many there are."""
    return df.join(bounded(numbered(df, label, name)), label, "left")


def first_true_index(df: DataFrame, text: str, name: str = "label_index") -> DataFrame:
    """Index of the first true key of a dict text among all keys of the column, sorted; 0 if there is none."""
    keys = df.select(F.explode(dict_keys(F.col(text))).alias("_key"))
    place = bounded(numbered(keys, "_key", name))
    out = df.withColumn("_first", first_true(F.col(text))).join(place, F.col("_first") == F.col("_key"), "left")
    return out.withColumn(name, F.coalesce(name, F.lit(0))).drop("_first", "_key")


def one_vs_rest(df: DataFrame, label: str, normal: str, drop: tuple[int, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """0 for the normal label and 1 for any other; other columns by position as f0..fN, bad numbers 0.0."""
    feats = [c for i, c in enumerate(c for c in df.columns if c != label and c not in keep) if i not in drop]
    cols = [number_or_zero(F.col(c)).alias(f"f{i}") for i, c in enumerate(feats)]
    return df.select(*keep, *cols, (F.trim(label) != normal).cast("int").alias("target"))


def interval_label(
    points: DataFrame, ts: str, intervals: DataFrame, start: str, end: str, width: int
) -> DataFrame:
    """1 if the time lies in any interval (ends included), else 0.

    Time is cut into buckets of ``width`` seconds; an interval is listed in every bucket it touches, so the
    search is an equi join. Overlapping intervals of a bucket are merged first: a point then meets at most one,
    and a single left join keeps every point exactly once.
    """
    def bucket(c):
        return F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / width)

    spread = intervals.select(
        F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(bucket(start), bucket(end))).alias("_bucket")
    )
    order = Window.partitionBy("_bucket").orderBy("_s", "_e")
    reached = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reached.isNull() | (F.col("_s") > reached), 1).otherwise(0)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = (
        spread.withColumn("_new", starts).withColumn("_island", island).groupBy("_bucket", "_island")
        .agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).withColumnRenamed("_bucket", "_b")
    )
    cut = points.withColumn("_bucket", bucket(ts))
    hit = cut.join(bounded(merged), (F.col("_bucket") == F.col("_b")) & F.col(ts).between(F.col("_s"), F.col("_e")), "left")
    return hit.withColumn("target", F.col("_s").isNotNull().cast("int")).drop("_bucket", "_b", "_s", "_e", "_island")


def json_intervals(df: DataFrame, text: str, start: str = "start", end: str = "end") -> DataFrame:
    """Intervals of a JSON text that lists ``[start, end]`` pairs of timestamp texts; pairs that can't be read are left out."""
    pairs = df.select(F.explode(F.from_json(text, "array<array<string>>")).alias("_pair"))
    read = pairs.select(*[F.get("_pair", F.lit(i)).try_cast("timestamp_ntz").alias(n) for i, n in enumerate((start, end))])
    return read.where(F.col(start).isNotNull() & F.col(end).isNotNull())


def sparse_to_columns(df: DataFrame, features: str, key_rows: int | None = None, limit: int = 5_000) -> DataFrame:
    """One column per key of a map column, sorted, missing keys 0.0.

    Keys are taken from all rows. ``key_rows`` takes them from the first rows only, as row-by-row loaders do, and drops
    keys first seen later. A table can't have columns without end: beyond ``limit`` keys it stays a map.
    """
    seen = df if key_rows is None else df.filter(F.col("step") <= key_rows)
    keys = sorted(r[0] for r in seen.select(F.explode(F.map_keys(features)).alias("key")).distinct().limit(limit + 1).collect())
    if len(keys) > limit:
        raise ValueError(f"more than {limit} feature names: keep the map form")
    rest = [c for c in df.columns if c != features]
    return df.select(*rest, *[F.coalesce(F.get(F.array(F.col(features)[k]), 0), F.lit(0.0)).alias(f"x_{k}") for k in keys])


def standardised(stream: Stream, columns: list[str], prefix: str = "z_") -> DataFrame:
    """Features scaled by the mean and variance of the earlier rows; zero variance (and the first row) give 0."""
    out = moments(stream, columns)
    scaled = {
        f"{prefix}{c}": F.when(F.col(f"{c}_var") > 0, (F.col(c) - F.col(f"{c}_mean")) / F.sqrt(f"{c}_var")).otherwise(0.0)
        for c in columns
    }
    return out.withColumns(scaled).drop(*[f"{c}_{k}" for c in columns for k in ("n", "mean", "var")])


def ensure_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Add missing columns as NULL and read the listed ones as numbers (bad text = NULL)."""
    return df.withColumns({c: number_or_null(F.col(c)) if c in df.columns else F.lit(None).cast("double") for c in names})


def normal_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def looked_up(c: Column, names: dict[str, str]) -> Column:
    """Name from a fixed table, itself if not listed."""
    pairs = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(pairs, c), c)


def first_alias(df: DataFrame, accepted: list[str], name: str) -> DataFrame:
    """Rename the first accepted column that exists; others of the list stay."""
    for c in accepted:
        if c in df.columns:
            return df if c == name else df.withColumn(name, F.col(f"`{c}`"))
    return df


def filled_prediction(pred: Column, after: int = 20, value: object = 0) -> Column:
    """A missing prediction becomes ``value`` once more than ``after`` rows were seen."""
    return F.coalesce(pred, F.when(F.col("step") - 1 > after, F.lit(value)))
