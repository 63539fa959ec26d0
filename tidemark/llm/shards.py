"""Sharding by bytes: prefix sums of sizes over one order, cut at equal targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, plain, ranked
from tidemark.session import written


def byte_shards(df: DataFrame, size: str, order: Sequence[str], shards: int) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (0-based place in the shard), under the law ``bytes``.

    Rows stand in ``order``; the sizes before a row are the totals of earlier range partitions plus a running sum in its
    own. A row goes to the shard in which the middle of its bytes falls when all bytes are cut in equal parts, so shards
    are contiguous and a shard's bytes differ from the target by less than one row. All columns are kept. Ties in
    ``order`` fall in any order, null sorts first. If all sizes are 0 (or the table is empty) rows are cut by count.
    A shard may stay empty when single rows exceed the target. If ``df`` has columns of these
    names, the new ones get an underscore more.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    packed = df.select(
        F.struct(*plain(df)).alias("_row"), F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0)).alias("_size"),
        *(F.col(f"`{c}`").alias(k) for c, k in zip(order, keys, strict=True)),
    )
    placed = written(ranked(packed, keys, size="_size", label="shards"), "shards-ranked")
    n, total = placed.agg(F.count(F.lit(1)), F.sum("_size")).first()
    at = F.col("_before") + F.col("_size") / 2 if total else F.col("_rank") + F.lit(0.5)
    cut = placed.withColumn("_shard", F.least(F.lit(shards - 1), F.floor(at * shards / F.lit(float(total or n or 1)))).cast("int"))
    first = cut.groupBy(F.col("_shard").alias("_of")).agg(F.min("_rank").alias("_first"))  # a row a shard
    shard, slot = fresh(df, "shard", "slot")
    out = cut.join(F.broadcast(first), F.col("_shard") == F.col("_of"))
    return out.select("_row.*", F.col("_shard").alias(shard), (F.col("_rank") - F.col("_first")).alias(slot))


def write_shards(df: DataFrame, path: str) -> None:
    """Sharded rows as one folder a shard, in slot order within each file."""
    w = df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    w.write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """A row for each document (null and empty texts have size 8), ordered by doc_id; repeated rows keep a place each."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    out = byte_shards(written(narrow, "shard-sizes"), "size", ["doc_id", "text_crc32"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: For the check: CRC-32 byte by byte from its table (polynomial 0xEDB88320), then prefix sums over all documents.
SQL = """
WITH tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 + 8 AS size, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes FROM d),
c AS (SELECT doc_id, size, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, bytes),
         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])))::BIGINT AS text_crc32 FROM b, tbl),
p AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM c
      WINDOW w AS (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(23, floor((before + size / 2.0) * 24 / total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot,
       NULL::INT AS grown_shard FROM s
"""
