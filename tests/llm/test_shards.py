import zlib
from itertools import pairwise

from tidemark.llm import shards
from tidemark.llm.queries import table

KIND = "doc_id bigint, text string, shard string, _size int"


def check(rows, n):
    """The law: contiguous in order, each row where the middle of its bytes falls, slots without gaps."""
    total, at, slots = sum(r["size"] for r in rows), 0, {}
    for r in rows:
        assert r["shard"] == min(n - 1, int((at + r["size"] / 2) * n / total))
        assert r["slot"] == slots.get(r["shard"], 0)
        slots[r["shard"]] = r["slot"] + 1
        at += r["size"]


def test_all_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = sorted((r.asDict() for r in shards.digest(docs).collect()), key=lambda r: r["doc_id"])
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert [r["doc_id"] for r in rows] == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
    check(rows, 24)
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(24)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)


def test_edges(spark):
    rows = [(i % 3 or None, t, "x", 1) for i, t in enumerate([None, "", "é", "same", "same", "y" * 200_000, "same"])]
    docs = spark.createDataFrame(rows, KIND)
    got = shards.digest(docs).collect()
    assert sorted(r.size for r in got) == [8, 8, 10, 12, 12, 12, 200_008]
    placed = [(r.shard, r.slot) for r in got]
    assert len(set(placed)) == len(rows)
    kept = shards.byte_shards(docs.withColumn("n", docs["_size"]), "n", ["doc_id"], 2)
    assert kept.columns == ["doc_id", "text", "shard", "_size", "n", "shard_", "slot"]
    assert shards.digest(docs.limit(0)).count() == 0


def test_no_bytes_cuts_by_count(spark):
    df = spark.range(10).selectExpr("id", "cast(null as int) as size")
    got = sorted((r.id, r.shard) for r in shards.byte_shards(df, "size", ["id"], 5).collect())
    assert [s for _, s in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_partitioning_does_not_matter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    a, b = (sorted(map(tuple, shards.digest(d).collect()), key=str) for d in (docs, docs.repartition(7)))
    assert a == b


def test_written_shards(spark, tmp_path):
    out = shards.byte_shards(spark.range(100).selectExpr("id", "id as size"), "size", ["id"], 4)
    shards.write_shards(out, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s").orderBy("shard", "slot").collect()
    assert all(a.id + 1 == b.id for a, b in pairwise(back))
