"""The given tables as labelled streams."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.stream import Stream, prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code(column: Column, values: tuple[str, ...]) -> Column:
    """1.0, 2.0, ... for the listed values in order."""
    out = F.lit(None).cast("double")
    for i, v in enumerate(values):
        out = F.when(column == v, float(i + 1)).otherwise(out)
    return out


EVENT_FEATURES = ("value", "hour", "k")
ORDER_FEATURES = ("month", "priority", "state")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATES = ("F", "O", "P")


EVENT_SOURCE = ("event_id", "ts", "user_id", "event_type", "value", "props")
ORDER_SOURCE = ("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")


def event_columns() -> tuple[Column, ...]:
    return (
        *[F.col(c) for c in EVENT_SOURCE if c != "props"],
        F.hour("ts").cast("double").alias("hour"),
        (F.col("user_id") % 10).cast("double").alias("u"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        (F.col("event_type") == "error").cast("int").alias("is_error"),
        (F.col("value") > 200).cast("int").alias("is_high"),
    )


def order_columns() -> tuple[Column, ...]:
    return (
        *[F.col(c) for c in ORDER_SOURCE if c != "o_orderpriority"],
        F.month("o_orderdate").cast("double").alias("month"),
        code(F.col("o_orderpriority"), PRIORITIES).alias("priority"),
        code(F.col("o_orderstatus"), STATES).alias("state"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*event_columns())


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(*order_columns())


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _li(spark, d):
    order = (
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )
    return prepare(lineitems(spark, d).select(*order), order, "l_extendedprice", ("l_quantity", "l_discount", "l_tax"))


def _emb(spark, d):
    vectors = table(spark, d, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")
    )
    return prepare(vectors, ("vec_id",), "label", ("embedding",))


def _ev(spark, d, features, by=()):
    rows = table(spark, d, "events").select(*EVENT_SOURCE)
    return prepare(rows, ("event_id",), "value", features, by, event_columns())


def _ev_targets(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "event_type", "value")
    columns = (*[F.col(c) for c in rows.columns], (F.col("event_type") == "error").cast("int").alias("is_error"))
    return prepare(rows, ("event_id",), "value", columns=columns, blocks=False)


def _ord_targets(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return prepare(rows, ("o_orderkey",), "o_totalprice", blocks=False)


def _ord(spark, d):
    rows = table(spark, d, "orders").select(*ORDER_SOURCE)
    return prepare(rows, ("o_orderkey",), "o_totalprice", ("o_totalprice", *ORDER_FEATURES), columns=order_columns())


_BUILD = {
    "ev": lambda s, d: _ev(s, d, ("value", "hour", "u", "k")),
    "ord": _ord,
    "li_reg": _li,
    "ev_keyed": lambda s, d: _ev(s, d, ("hour", "u", "k"), ("user_id",)),
    "emb_multi": _emb,
    "ev_targets": _ev_targets,
    "ord_targets": _ord_targets,
}
# (prepared table, target, features): several streams read the same prepared rows
_VIEWS = {
    "ev_reg": ("ev", "value", ("hour", "u", "k")),
    "ev_multi": ("ev", "event_type", EVENT_FEATURES),
    "ev_bin": ("ev", "is_error", EVENT_FEATURES),
    "ev_anom": ("ev", "is_high", ("value",)),
    "ord_reg": ("ord", "o_totalprice", ORDER_FEATURES),
    "ord_multi": ("ord", "o_orderstatus", ("o_totalprice", "month", "priority")),
}
_prepared: dict[tuple, Stream] = {}
_locks: dict[tuple, threading.Lock] = {}


def stream(spark: SparkSession, sf_dir: str, name: str) -> Stream:
    """A prepared stream. Preparation writes one table per session, which all later runs read."""
    base, target, features = _VIEWS.get(name, (name, None, None))
    built = _built(spark, sf_dir, base)
    if target is None:
        return built
    return Stream(built.df, built.n, target, features, built.by, built.centre, built.parts)


def target_stream(spark: SparkSession, sf_dir: str, name: str) -> Stream:
    """The rows of a stream over events or orders with their targets and times only, for what reads neither features nor blocks.

    The whole table is read if the session has it; else a narrow one is prepared, without work for the features.
    """
    base, target, _ = _VIEWS[name]
    if (spark.sparkContext.applicationId, str(sf_dir), base) not in _prepared:
        base = f"{base}_targets"
    built = _built(spark, sf_dir, base)
    return Stream(built.df, built.n, target, (), built.by, {}, built.parts)


def _built(spark: SparkSession, sf_dir: str, base: str) -> Stream:
    key = (spark.sparkContext.applicationId, str(sf_dir), base)
    with _locks.setdefault(key, threading.Lock()):
        if key not in _prepared:
            _prepared[key] = _BUILD[base](spark, sf_dir)
        return _prepared[key]
