"""Ordered, labelled streams.

A stream is a table whose rows carry ``step`` = 1..n in stream order. Numbering never uses a window over
all rows: rows are range partitioned and sorted by the order key, every row keeps its partition number
and its position inside the partition, and the partition sizes (a handful of numbers) give the offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.session import scratch_path

POSITION_MASK = (1 << 33) - 1
MAX_BROADCAST_CHUNKS = 100_000
#: Rows of a file of a kept stream, so that a block of the stream lies in about as many files as there are cores, however long the stream.
FILE_ROWS = 25_000
#: The same for a stream that is only read whole.
WHOLE_FILE_ROWS = 250_000
#: Files of a stream; a longer one has larger files.
MAX_FILES = 20_000


@dataclass
class Stream:
    """A prepared stream; ``by`` names the key columns of a fleet of streams (empty = one stream)."""

    df: DataFrame
    n: int
    target: str
    features: tuple[str, ...]
    by: tuple[str, ...] = ()
    centre: dict[str, float] = field(default_factory=dict)
    parts: tuple[tuple[int, int], ...] = ()  # (partition, rows before it)

    @cached_property
    def chunk_rows(self) -> int:
        """Rows per prefix-scan chunk: enough chunks for all cores, never more rows than a task can sort."""
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        return min(262_144, max(512, math.ceil(self.n / (4 * cores))))

    @property
    def n_chunks(self) -> int:
        return math.ceil(max(self.n, 1) / self.chunk_rows)

    def chunk(self, rows: int | None = None) -> Column:
        return F.floor((F.col("step") - 1) / (rows or self.chunk_rows)).cast("long")

    def between(self, lo: int, hi: int, df: DataFrame | None = None) -> DataFrame:
        """Rows lo..hi by step. ``step`` is computed, so the partitions that hold the rows are named as well:
        that filter skips the other folders."""
        df = self.df if df is None else df
        df = df.filter(F.col("step").between(lo, hi))
        if self.by or "_part" not in df.columns:
            return df
        ends = [before for _, before in self.parts[1:]] + [self.n]
        hit = [p for (p, before), end in zip(self.parts, ends) if before < hi and end >= lo]
        return df.filter(F.col("_part").between(min(hit), max(hit))) if hit else df


def parallelism(df: DataFrame, per_core: int = 2) -> int:
    """Partitions for work that must stay spread even if the data looks small (sorted files, Python groups)."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return max(per_core * cores, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _numbered(df: DataFrame, order: tuple[str, ...], columns: tuple[Column, ...], blocks: bool) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, "stream")
    # a block of the stream, a contiguous part of it, is read by many tasks from folders that no other block needs
    parts = max(parallelism(df, 4), min(math.ceil(df.count() / (FILE_ROWS if blocks else WHOLE_FILE_ROWS)), MAX_FILES))
    # the range partitioner reads its input twice, for the ranges and for the rows: what is computed is computed behind it
    rows = (
        df.repartitionByRange(parts, *[F.col(c) for c in order])
        .select(*(columns or ["*"]), F.spark_partition_id().alias("_part"))
        .sortWithinPartitions(*(["_part"] if blocks else []), *order)
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(POSITION_MASK)))
    )
    if not blocks:
        rows.write.parquet(path)
        return df.sparkSession.read.schema(rows.schema).parquet(path), path
    rows.write.partitionBy("_part").parquet(path)
    kind = StructType([*[f for f in rows.schema.fields if f.name != "_part"], StructField("_part", IntegerType())])
    return df.sparkSession.read.schema(kind).parquet(path), path


def prepare(
    df: DataFrame,
    order: tuple[str, ...],
    target: str,
    features: tuple[str, ...] = (),
    by: tuple[str, ...] = (),
    columns: tuple[Column, ...] = (),
    blocks: bool = True,
) -> Stream:
    """Number the rows of ``df`` by ``order`` (which must be a total order) and keep the stream as a table.

    ``columns`` makes the columns of the stream, with those of ``order`` and ``by`` unchanged, out of ``df`` (default: as they are).
    Without ``blocks`` the table lies in fewer and larger files of one folder, for a stream whose blocks are not read one by one.
    """
    spark = df.sparkSession
    rows, _ = _numbered(df, (*by, *order), columns, blocks)
    numeric = [c for c, t in rows.dtypes if t in ("double", "float", "int", "bigint") and c in (target, *features)]
    sizes = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("size"), *[F.sum(F.col(c).cast("double")).alias(f"s_{c}") for c in numeric])
        .orderBy("_part")
        .collect()
    )
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row["_part"], total))
        total += row["size"]
    centre = {c: sum(r[f"s_{c}"] or 0.0 for r in sizes) / max(total, 1) for c in numeric}
    if not offsets:
        stepped = rows.withColumn("step", F.lit(0).cast("long"))
    else:
        small = spark.createDataFrame(offsets, "_part int, _offset long")
        stepped = rows.join(F.broadcast(small), "_part").withColumn("step", F.col("_offset") + F.col("_pos") + 1)
    stepped = stepped.drop("_pos", "_offset")
    if by:
        starts = stepped.groupBy(*by).agg((F.min("step") - 1).alias("_start"))
        stepped = stepped.join(starts, list(by)).withColumn("step", F.col("step") - F.col("_start")).drop("_start", "_part")
    return Stream(stepped, total, target, tuple(features), tuple(by), centre, tuple(offsets))
