"""Checkpoint blocks: tumbling windows by row count.

Two rules are in use. ``floor`` (interval ``n // 50``, the tail always reported) and ``ceil`` (interval
``ceil(n / 50)``, a partial tail not reported unless it is the only row).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number of checkpoints, and what is assumed for a stream of unknown length.
N_CHECKPOINTS = 50
UNKNOWN_LENGTH = 10_000
UNKNOWN_INTERVAL = 1_000


def interval(n: int | None, rule: str = "floor", checkpoints: int = N_CHECKPOINTS) -> int:
    if rule == "floor":
        return max(1, (UNKNOWN_LENGTH if n is None else n) // checkpoints)
    if not n:
        return UNKNOWN_INTERVAL
    return max(1, math.ceil(n / checkpoints))


def block(step: Column, every: int) -> Column:
    """1-based block of a row; the rows of block b are reported at checkpoint b."""
    return F.ceil(step / F.lit(every)).cast("long")


def n_blocks(n: int, every: int) -> int:
    return math.ceil(n / every)


def reported(df: DataFrame, n: int, every: int, rule: str = "floor") -> DataFrame:
    """Turn cumulative block rows into checkpoint rows with a ``step`` column."""
    df = df.withColumn("step", F.least(F.col("block") * every, F.lit(n)).cast("long"))
    if rule == "ceil" and n >= every:
        df = df.filter(F.col("block") * every <= n)
    return df.drop("block")


def checkpoint_steps(rows: DataFrame, n: int, rule: str = "floor") -> DataFrame:
    """The rows of a stream at which a checkpoint falls."""
    every = interval(n, rule)
    hit = F.col("step") % every == 0
    tail = F.col("step") == n
    if rule == "floor" or n < every:
        hit = hit | tail
    return rows.filter(hit)
