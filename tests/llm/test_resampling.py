import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import resampling
from tidemark.llm.queries import table

KIND = "doc_id bigint, text string, rank string, weight int"


def grams(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, percent=5, least=20):
    """The contract in loops: {row number: (doc_id, n_features, weight, score, rank)}."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for text in texts for f in grams(text)[0]) for texts in ([x[1] for x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = {}
    for i, (doc, text) in enumerate(docs):
        found, words = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in map(bucket, found))
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [doc, len(found), weight, score, None, words]
    able = sorted((r for r in out.values() if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out.values()), key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


def test_all_documents(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in benchmark.collect()])
    got = rows(resampling.digest(docs, benchmark))
    assert got == want
    assert any(r[4] for r in got)
    assert rows(resampling.digest(docs.repartition(7), benchmark)) == want


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 64)
    some = "One two  THREE ÉÀ x_y don't 1a " * 5
    texts = [None, "", "...", "a", "a b", "word " * 30, "word " * 30, some, "z" * 5000 + " q" * 40, "日本 語 " * 20]
    docs = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(7, some), (7, some), (-3, "word " * 25)]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], KIND)
    target = ["word one", None, "", some]
    target_frame = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    out = resampling.draw(resampling.weigh(frame, target_frame), n_features="n_features", score="score", percent=60)
    assert out.columns == ["doc_id", "text", "rank", "weight", "n_features", "weight_", "score", "rank_"]
    got = sorted(((r.doc_id, r.n_features, r.weight_, r.score, r.rank_) for r in out.collect()), key=str)
    assert got == plain(docs, target, percent=60)
    kept = resampling.sample(frame, target_frame)
    assert kept.columns == frame.columns
    assert resampling.digest(frame.limit(0), target_frame).count() == 0
    empty = resampling.digest(frame, target_frame.limit(0))
    assert rows(empty) == plain(docs, [])


def test_running_crc():
    crc = resampling.RunningCrc()
    parts = [(b"abc", b"d" * n) for n in (1, 5, 63, 64, 65, 1000)]
    got = crc.shift(np.array([zlib.crc32(a) for a, _ in parts], np.uint32), np.array([len(b) for _, b in parts]))
    assert [int(g) ^ zlib.crc32(b) for g, (_, b) in zip(got, parts, strict=True)] == [zlib.crc32(a + b) for a, b in parts]


def test_radix_ranks(spark):
    big = [(1 << 63) - 1, -(1 << 63), 0, 5, -5, 1 << 40, 5]
    data = [(a, b) for a in big for b in (3, -3, 3)] + [(None, 1), (2, None)]
    for descending in (True, False):
        ranked = resampling.radix_ranks(spark.createDataFrame(data, "a bigint, b bigint").repartition(5), [("a", descending), ("b", not descending)])
        got = [(r.a, r.b) for r in sorted((r for r in ranked.collect() if r["rank"]), key=lambda r: r["rank"])]
        sign = -1 if descending else 1
        assert got == sorted(((a, b) for a, b in data if a is not None and b is not None), key=lambda r: (sign * r[0], -sign * r[1]))
        assert sorted(r["rank"] for r in ranked.collect() if r["rank"]) == list(range(1, 22))
        assert ranked.where("rank is null").count() == 2


def test_one_key_for_all(spark):
    ranked = resampling.radix_ranks(spark.range(1000).selectExpr("id", "7 as k").repartition(6), [("k", True)])
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 1001))
