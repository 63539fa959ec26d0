"""Bounded spans of a stream with some history, for operators that look at the most recent rows.

Rows are cut into spans of ``size`` rows; rows near the end of a span are sent to the next span too, as
history. A group therefore never holds more than ``size + reach`` rows, whatever the length of the stream.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.stream import parallelism

SPAN_ROWS = 4096


def spanned(rows: DataFrame, reach: int, size: int | None = None) -> tuple[DataFrame, int]:
    """Rows with their ``_span``; history rows appear a second time. Returns the span size as well."""
    size = max(size or SPAN_ROWS, reach)
    span = F.floor((F.col("step") - 1) / size).cast("long")
    near_end = (F.col("step") - 1) % size >= size - reach
    spans = F.when(near_end, F.array(span, span + 1)).otherwise(F.array(span))
    return rows.withColumn("_span", F.explode(spans)), size


def apply_spans(rows: DataFrame, n: int, reach: int, fn, schema: str, size: int | None = None) -> DataFrame:
    """``fn(rows, first)`` per span of the ``n`` rows: rows sorted by step, output expected for rows with ``step >= first``."""
    cut, size = spanned(rows, reach, size)

    def run(key, pdf):
        pdf = pdf.sort_values("step", kind="stable").reset_index(drop=True)
        return fn(pdf, int(key[0]) * size + 1)

    return _grouped(cut, n, size).applyInPandas(run, schema)


def apply_spans_arrow(rows: DataFrame, n: int, reach: int, fn, schema: str, size: int | None = None) -> DataFrame:
    """The same with Arrow tables, for results of nested columns."""
    cut, size = spanned(rows, reach, size)

    def run(key, table):
        return fn(table.combine_chunks().sort_by("step"), key[0].as_py() * size + 1)

    return _grouped(cut, n, size).applyInArrow(run, schema)


def _grouped(cut: DataFrame, n: int, size: int):
    parts = min(parallelism(cut), math.ceil(n / size) + 1)
    return cut.repartition(parts, "_span").groupBy("_span")
