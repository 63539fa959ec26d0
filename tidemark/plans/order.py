"""Places in a sorted order, without a global window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written


def numbered(values: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct non-null values of ``column`` with their 0-based place in ascending order, however many there are.

    Values are range partitioned; only the sizes of the partitions meet in the driver.
    """
    parts = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    table = written(parts.withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = {r["_part"]: r["count"] for r in table.groupBy("_part").count().collect()}
    offsets, seen = [], 0
    for part in sorted(sizes):
        offsets.append((part, seen))
        seen += sizes[part]
    start = F.broadcast(values.sparkSession.createDataFrame(offsets, "_part int, _start long"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    return table.withColumn(name, place).join(start, "_part").select(column, (F.col(name) + F.col("_start")).cast("int").alias(name))
