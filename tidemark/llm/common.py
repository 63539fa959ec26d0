"""Helpers that several text operators share."""

from __future__ import annotations

import sys
import types
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written

#: A side table is broadcast up to this many rows (of a few numbers each: some 32 MB); beyond it Spark shuffles both sides.
BROADCAST_ROWS = 1_000_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def plain(df: DataFrame, *names: str) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col(f"`{c}`") for c in (names or df.columns)]


def body(c: Column | str) -> Column:
    """A text as UTF-8 bytes, which Python workers get without decoding."""
    return (F.col(c) if isinstance(c, str) else c).cast("string").cast("binary")


def crc_mod(c: Column | str, n: int) -> Column:
    """crc32 of a number's decimal text, modulo ``n``; null stays null."""
    return F.crc32((F.col(c) if isinstance(c, str) else c).cast("string")) % n


def worker_state() -> dict:
    """A dictionary that lives as long as a Python worker process, which runs one task after another.

    Functions reach workers by value, and their modules' variables with them anew for each task, so this one is kept in a
    module that only the process itself knows.
    """
    name = "_tidemark_worker"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].state = {}
    return sys.modules[name].state


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if its rows are counted below the bound, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def labelled(docs: DataFrame, labels: DataFrame, column: str, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the label as the last column ``_label``: the smallest of a document's labels, null if it has none."""
    one = labels.where(F.col(doc_id).isNotNull() & F.col(column).isNotNull()).groupBy(F.col(doc_id).alias("_label_of")).agg(F.min(column).cast("int").alias("_label"))
    return docs.join(small(one), F.col(doc_id) == F.col("_label_of"), "left").drop("_label_of")


def ranked(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), size: str | None = None, label: str = "ranked") -> DataFrame:
    """``df`` with ``_rank`` (0-based place in ``order`` among the rows of ``by``) and, for ``size``, ``_before`` (sum of earlier sizes).

    Rows are range partitioned and kept in the shared folder; totals per partition, one row each, give the offsets,
    so no task sees more than a partition. Equal rows get different ranks. Null sorts first.
    """
    keys = [*by, *order]
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = spread.repartitionByRange(*keys, "_tie").withColumn("_part", F.spark_partition_id())
    table = written(parts, label)
    sums = [F.count(F.lit(1)).alias("_n")] + ([F.sum(size).alias("_s")] if size else [])
    totals = [r.asDict() for r in table.groupBy("_part", *by).agg(*sums).collect()]  # a row or a few for each partition
    rows, seen, total = [], {}, {}
    for r in sorted(totals, key=lambda r: r["_part"]):
        k = tuple(r[b] for b in by)
        rows.append((r["_part"], *k, seen.get(k, 0), total.get(k, 0)))
        seen[k] = seen.get(k, 0) + r["_n"]
        total[k] = total.get(k, 0) + ((r["_s"] or 0) if size else 0)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(["_part int", *(f"`_by_{b}` {kinds[b]}" for b in by), "_rank0 bigint", "_before0 bigint"])
    offsets = df.sparkSession.createDataFrame(rows, schema)
    same = [F.col(b).eqNullSafe(F.col(f"`_by_{b}`")) for b in by]
    w = Window.partitionBy("_part", *by).orderBy(*order, "_tie")
    table = table.withColumn("_rank", F.row_number().over(w) - 1)
    if size:
        table = table.withColumn("_before", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    joined = table.withColumnRenamed("_part", "_p").join(F.broadcast(offsets), (F.col("_p") == F.col("_part")) if not same else (F.col("_p") == F.col("_part")) & same[0])
    out = joined.withColumn("_rank", F.col("_rank") + F.col("_rank0"))
    if size:
        out = out.withColumn("_before", F.col("_before") + F.col("_before0"))
    return out.drop("_tie", "_p", "_part", "_rank0", "_before0", *(f"_by_{b}" for b in by))
