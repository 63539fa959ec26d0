"""Block models: block b is scored with the state fitted on blocks before b.

Updates arrive at block ends, which is a documented change against the row-by-row loop. One aggregation job
per block at most; the driver only combines its small result. Row data never reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.plans.stream import FILE_ROWS, Stream
from tidemark.session import scratch_path

#: Rows of a block for each core, so that a block keeps a cluster busy whatever its size.
ROWS_A_CORE = 25_000


@dataclass
class Blocks:
    """Equal blocks of a stream."""

    stream: Stream
    count: int = 10

    @property
    def size(self) -> int:
        return max(1, math.ceil(self.stream.n / self.count))

    @property
    def used(self) -> int:
        return math.ceil(self.stream.n / self.size) if self.stream.n else 0

    @classmethod
    def of_rows(cls, stream: Stream, rows: int | None = None, least: int = 6) -> "Blocks":
        """Blocks of at most ``rows`` rows (default: so many for each core of the session), so that a model learns more often from a
        longer stream; at least ``least`` blocks. Results depend on the cut: give ``rows`` to repeat them on another cluster."""
        if rows is None:
            rows = ROWS_A_CORE * stream.df.sparkSession.sparkContext.defaultParallelism
        return cls(stream, max(least, math.ceil(stream.n / rows)))

    def number(self) -> Column:
        """1-based block of a row."""
        return F.ceil(F.col("step") / self.size).cast("int")

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` (with ``step``) as a table whose folders are blocks, for rows that every block would else compute anew.
        Files are small, so that a block is read by many tasks."""
        path = scratch_path(df.sparkSession, label)
        df.withColumn("_block", self.number()).write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_block").parquet(path)
        kind = StructType([*df.schema.fields, StructField("_block", IntegerType())])
        return df.sparkSession.read.schema(kind).parquet(path)

    def rows(self, b: int, df: DataFrame | None = None) -> DataFrame:
        if df is not None and "_block" in df.columns:
            return df.where(F.col("_block") == b).drop("_block")
        return self.stream.between((b - 1) * self.size + 1, b * self.size, df)

    def with_state(self, states: list[dict], schema: str, rows: DataFrame | None = None) -> DataFrame:
        """Join the state before each block to its rows; ``states[b]`` is fitted on blocks 1..b.

        The state table has one row per block, so it is always small enough to broadcast.
        """
        rows = (self.stream.df if rows is None else rows).withColumn("block", self.number())
        spark = rows.sparkSession
        table = spark.createDataFrame([{"block": b + 1, **s} for b, s in enumerate(states)], f"block int, {schema}")
        return rows.join(F.broadcast(table), "block", "left")


class BlockModel(Protocol):
    """What a model needs in order to run in blocks; user models plug in here.

    ``empty`` is the state before any row. ``totals`` names the aggregates one block must deliver, given the
    state. ``learn`` folds them into the next state. ``columns`` / ``schema`` put a state into a table row,
    and ``predict`` is an expression over those columns and the features.
    """

    name: str
    schema: str

    def empty(self) -> Any: ...

    def totals(self, state: Any) -> dict[str, Column]: ...

    def learn(self, state: Any, sums: dict[str, float]) -> Any: ...

    def columns(self, state: Any) -> dict: ...

    def predict(self) -> Column: ...


def run_blocks(blocks: Blocks, models: list, rows: DataFrame | None = None) -> DataFrame:
    """Fit all models with one job per block and add one prediction column per model."""
    rows = blocks.stream.df if rows is None else rows
    state = {m.name: m.empty() for m in models}
    history = {m.name: [state[m.name]] for m in models}
    for b in range(1, blocks.used):
        aggs = {f"{i}__{k}": c for i, m in enumerate(models) for k, c in m.totals(state[m.name]).items()}
        sums = blocks.rows(b, rows).agg(*[c.alias(k) for k, c in aggs.items()]).collect()[0].asDict()
        for i, m in enumerate(models):
            mine = {k.split("__", 1)[1]: v for k, v in sums.items() if k.startswith(f"{i}__")}
            state[m.name] = m.learn(state[m.name], mine)
            history[m.name].append(state[m.name])
    out = rows
    states = [
        {f"{m.name}__{k}": v for m in models for k, v in m.columns(history[m.name][b]).items()} for b in range(blocks.used)
    ]
    schema = ", ".join(
        f"`{m.name}__{part.strip().split(' ', 1)[0]}` {part.strip().split(' ', 1)[1]}" for m in models for part in m.schema.split(";")
    )
    out = blocks.with_state(states, schema, out)
    out = out.withColumns({m.name: m.predict() for m in models})
    return out.drop(*[c for c in out.columns if any(c.startswith(f"{m.name}__") for m in models)])
