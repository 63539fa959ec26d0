"""Gaussian naive Bayes, exact per row: all statistics are prefix sums."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.prefix import scan
from tidemark.plans.stream import Stream

VARIANCE_FLOOR = 1e-9


def best_class(scores: list[Column], classes: list) -> Column:
    """Class with the highest score, the smallest label on ties; NULL scores do not take part."""
    if len(classes) == 1:
        return F.when(scores[0].isNotNull(), F.lit(classes[0]))
    top = F.greatest(*scores)
    return F.coalesce(*[F.when(s == top, F.lit(c)) for s, c in zip(scores, classes)])


def gaussian_nb(stream: Stream, classes: list, features: list[str], name: str = "naive_bayes", rows: DataFrame | None = None) -> DataFrame:
    """Class prior times normal densities, from the rows before; NULL before the first label."""
    y = F.col(stream.target)
    around = {f: f"(CAST(`{f}` AS DOUBLE) - {float(stream.centre.get(f, 0.0))!r}D)" for f in features}
    sums = {}
    for i, c in enumerate(classes):
        sums[f"_n{i}"] = F.when(y == c, 1.0).otherwise(0.0)
        for f in features:
            sums[f"_m{i}_{f}"] = F.expr(f"CASE WHEN `{f}` IS NULL THEN 0D ELSE _mine{i} END")
            sums[f"_s{i}_{f}"] = F.expr(f"_mine{i} * {around[f]}")
            sums[f"_q{i}_{f}"] = F.expr(f"_mine{i} * {around[f]} * {around[f]}")
    rows = (stream.df if rows is None else rows).withColumns({f"_mine{i}": sums[f"_n{i}"] for i in range(len(classes))})
    out = scan(stream, sums, rows=rows)
    seen = " + ".join(f"_n{i}" for i in range(len(classes)))
    scores = []
    for i in range(len(classes)):
        score = f"ln(_n{i} / ({seen}))"
        for f in features:
            mean = f"`_s{i}_{f}` / `_m{i}_{f}`"
            var = f"greatest(`_q{i}_{f}` / `_m{i}_{f}` - ({mean}) * ({mean}), {VARIANCE_FLOOR}D)"
            density = f"0.5D * ln({2 * math.pi!r}D * {var}) + ({around[f]} - {mean}) * ({around[f]} - {mean}) / (2 * {var})"
            # a missing value says nothing about the class, nor does a feature not yet seen in it
            score += f" - CASE WHEN `{f}` IS NULL OR `_m{i}_{f}` = 0 THEN 0D ELSE {density} END"
        scores.append(F.expr(f"CASE WHEN _n{i} > 0 THEN {score} END"))
    return out.withColumn(name, best_class(scores, classes)).drop(*sums, *[f"_mine{i}" for i in range(len(classes))])
