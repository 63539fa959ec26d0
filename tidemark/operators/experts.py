"""Combining experts whose predictions are columns of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.bayes import best_class
from tidemark.plans.prefix import scan
from tidemark.plans.stream import Stream


def voting(rows: DataFrame, members: list[str], classes: list, name: str = "voting") -> DataFrame:
    """Most frequent member prediction, the smallest label on ties. Members sit in one row: no shuffle."""
    votes = []
    for c in classes:
        mine = [F.when(F.col(m) == c, 1).otherwise(0) for m in members]
        votes.append(sum(mine[1:], mine[0]))
    some = F.coalesce(*[F.col(m).isNotNull() & F.lit(True) for m in members], F.lit(False))
    for m in members[1:]:
        some = some | F.col(m).isNotNull()
    return rows.withColumn(name, F.when(some, best_class(votes, classes)))


def exponential_weights(stream: Stream, rows: DataFrame, members: list[str], rate: float = 0.5, name: str = "ewa") -> DataFrame:
    """Average of the members with weights ``exp(-rate * loss so far)`` for the squared loss.

    Weights are taken relative to the best member, so they never all underflow.
    """
    y = F.col(stream.target)
    losses = {f"_loss_{m}": (y - F.col(m)) * (y - F.col(m)) for m in members}
    out = scan(stream, losses, rows=rows)
    best = F.least(*[F.col(c) for c in losses]) if len(losses) > 1 else F.col(next(iter(losses)))
    weights = [F.exp(-rate * (F.col(c) - best)) for c in losses]
    top = [w * F.col(m) for w, m in zip(weights, members)]
    return out.withColumn(name, sum(top[1:], top[0]) / sum(weights[1:], weights[0])).drop(*losses)
