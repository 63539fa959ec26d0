"""SimHash fingerprints and all links within a radius, by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, fresh, plain
from tidemark.llm.graph import components
from tidemark.session import written

BITS = 64
RADIUS = 2
#: Shingles hashed at a time, so that a very long text needs no more memory than this many.
BLOCK = 200_000


def fingerprint_of(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text as a signed 64-bit number; 0 without words."""
    words = (text or b"").lower().split()  # on bytes: A-Z only, and split at 0x20 and 0x09 to 0x0D only
    if not words:
        return 0
    width = min(width, len(words))
    count = len(words) - width + 1
    ones, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, count, BLOCK):
        n = min(BLOCK, count - at)
        rows = zip(*(words[at + i : at + i + n] for i in range(width)), strict=True)
        h = np.array([digest(b" ".join(s), seed) for s in rows], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > count, bitorder="little").view("<u8")[0]
    return int(bits.astype(np.int64))


def fingerprint(text: Column | str, width: int = 3, seed: int = 42) -> Column:
    """A column of fingerprints. Null and empty texts: 0."""

    @F.pandas_udf("bigint")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([fingerprint_of(t, width, seed) for t in texts], dtype="int64")

    return of.asNondeterministic()(body(text))  # so that filters never run it twice


def masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks of bits, of which any ``radius`` bits are missed by one at least.

    Bit i has a non-zero vector of radius + 1 bits; mask v holds the bits whose vector has an odd product with v. Any
    ``radius`` vectors leave a non-zero v that is even with all of them.
    """
    v = range(1, 2 ** (radius + 1))
    return [sum(1 << i for i in range(BITS) if (x & (1 + i % len(v))).bit_count() % 2) for x in v]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``u``, ``v`` between different fingerprints ``fp`` that connect exactly those within ``radius`` (0 to 2) bits.

    Fingerprints of one pair meet in the bucket of some mask. A bucket of two is compared. In a larger one each
    fingerprint also visits the fingerprints one free bit away: two are within 2 bits exactly if they share such a
    centre, and a centre has at most 65 visitors, so a crowded bucket is never put together or paired off.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius 0, 1 or 2")
    table = [(i, _signed(m)) for i, m in enumerate(masks(radius))]
    slots = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("key")) for i, m in table))
    spread = prints.select("fp", F.explode(slots).alias("s")).select("fp", "s.t", "s.key")
    full = written(spread.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1"), "buckets")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
    pairs = full.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v")).where(near)
    crowded = spread.join(full.where("n > 2").select("t", "key"), ["t", "key"], "left_semi")
    free = F.element_at(F.array(*(F.array(*(F.lit(_signed(1 << i)).cast("bigint") for i in range(BITS) if not m >> i & 1)) for m in masks(radius))), F.col("t") + 1)
    centres = crowded.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("bigint")), free)).alias("bit"))
    visits = centres.select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
    met = visits.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    hub = F.col("z") if radius < 2 else F.array_min("fps")
    stars = met.where(F.array_contains("fps", hub)).select(hub.alias("u"), F.explode("fps").alias("v")).where("u <> v").where(near)
    return pairs.unionByName(stars).distinct() if radius else pairs.where("u <> u")


def groups(docs: DataFrame, doc_id: str, fp: str, radius: int = RADIUS) -> DataFrame:
    """``docs`` (which has the fingerprints) with ``root`` (smallest fingerprint of its group) and ``component_id``.

    The component is the smallest doc_id of the group, null if all are null. Equal fingerprints, so also repeated rows
    and texts without words, are linked. All other columns are kept; names taken are lengthened by an underscore.
    """
    root_name, component = fresh(docs, "root", "component_id")
    prints = written(docs.groupBy(F.col(f"`{fp}`").alias("fp")).agg(F.min(f"`{doc_id}`").alias("least")), "prints")
    roots = components(links(prints.select("fp"), radius))
    member = prints.join(roots, prints.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("_root"))
    member = written(member, "members")
    least = member.groupBy("_root").agg(F.min("least").alias("_least"))
    named = member.select(F.col("fp").alias("_fp"), "_root").join(least, "_root")
    out = docs.join(named, docs[f"`{fp}`"] == named["_fp"])
    return out.select(*plain(docs), F.col("_root").alias(root_name), F.col("_least").alias(component))


def digest(docs: DataFrame) -> DataFrame:
    prints = written(docs.select("doc_id", fingerprint("text").alias("fp")), "fingerprints")
    return groups(prints, "doc_id", "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group: that with the smallest doc_id (null last), all columns kept.

    Repeated rows and rows of one doc_id count as rows of their own: only one row of a group stays. An empty table gives
    an empty table.
    """
    row, fp = fresh(docs, "_row", "_fp_of")
    kept = written(docs.select(*plain(docs), fingerprint(F.col(f"`{text}`")).alias(fp), F.monotonically_increasing_id().alias(row)), "printed")
    narrow = kept.select(F.col(f"`{doc_id}`").alias("d"), F.col(fp).alias("f"), F.col(row).alias("r"))
    grouped = groups(narrow, "d", "f", radius)
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("d").isNull().alias("a"), "d", "r")).alias("best")).select(F.col("best.r").alias("_best"))
    return kept.join(best, kept[row] == best["_best"], "left_semi").select(*plain(kept, *docs.columns))
