"""Importance resampling to a target distribution: bucket gains in one array, a Gumbel draw, and ranks by a distributed radix sort.

The sort is a least-significant-digit one. Each pass is a stable counting sort on one digit of the composite key: counts
by chunk and digit, prefix sums of these for the place of each (digit, chunk) run, and the place of a row inside its
run. Rows move once a pass, and a chunk holds a fixed number of places whatever the keys are, so no key is hot.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import body, fresh, plain
from tidemark.session import written

BUCKETS = 10_000
RUN = 3
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
#: Fixed by the definition of a word: lower-cased A-Z, digits and everything outside ASCII.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Bytes of text taken at a time.
BLOCK = 1 << 21
#: Bits of a digit, and the most rows of a chunk.
DIGIT_BITS = 11
CHUNK_ROWS = 1 << 20


class RunningCrc:
    """CRC-32 of joined texts from the CRC-32 of each: a CRC is shifted over the bytes behind it by table."""

    LONGEST = 64

    def __init__(self) -> None:
        one = np.array([self._byte(i) for i in range(256)], np.uint32)
        now = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
        tables = [now]
        for _ in range(self.LONGEST):
            now = (now >> np.uint32(8)) ^ one[now & np.uint32(255)]
            tables.append(now)
        self.flat = np.concatenate([t.ravel() for t in tables])

    @staticmethod
    def _byte(value: int) -> int:
        """The register after one more zero byte, as far as its lowest byte decides it (polynomial 0xEDB88320)."""
        for _ in range(8):
            value = (value >> 1) ^ 0xEDB88320 if value & 1 else value >> 1
        return value

    def shift(self, crc: np.ndarray, by: np.ndarray) -> np.ndarray:
        """The part that texts with these CRCs have in the CRC of themselves and ``by`` more bytes."""
        out, left = crc, by
        while True:
            at = np.minimum(left, self.LONGEST) << 10
            new = self.flat[at + (out & np.uint32(255))]
            for k in (1, 2, 3):
                new = new ^ self.flat[at + (k << 8) + ((out >> np.uint32(8 * k)) & np.uint32(255))]
            out, left = new, np.maximum(left - self.LONGEST, 0)
            if not left.any():
                return out


def _portions(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words of a text, some at a time, with how many at the front were there before."""
    text, at, kept = text.translate(_WORD), 0, []
    while at < len(text):
        end = len(text) if len(text) - at <= BLOCK else text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        words = kept + text[at:end].split()
        yield words, len(kept)
        kept, at = words[-(RUN - 1) :], end


def _gathered(texts: Sequence[bytes | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words of several texts in one list of bounded size, with (text, words, words there before) for each stretch."""
    words, stretches = [], []
    for i, text in enumerate(texts):
        for some, old in _portions(text or b""):
            words += some
            stretches.append((i, len(some), old))
            if len(words) >= BLOCK // 4:
                yield words, stretches
                words, stretches = [], []
    if words:
        yield words, stretches


def features(texts: Sequence[bytes | None], crc: RunningCrc, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bucket of each run of one to three words of the texts, and the text that it stands in."""
    space = np.uint32(zlib.crc32(b" "))
    for words, stretches in _gathered(texts):
        if not words:
            continue
        counts = np.array([n for _, n, _ in stretches])
        owner = np.repeat([i for i, _, _ in stretches], counts)
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        new = place >= np.repeat([old for _, _, old in stretches], counts)
        own = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        size = np.fromiter(map(len, words), np.int64, len(words))
        after = crc.shift(np.full(len(words), space), size) ^ own  # of the word with a space in front
        run = own
        for back in range(RUN):
            ok = new[back:] & (place[back:] >= back)
            yield run[ok] % np.uint32(buckets), owner[back:][ok]
            if back + 1 == RUN or len(run) <= 1:
                break
            run = crc.shift(run[:-1], size[back + 1 :] + 1) ^ after[back + 1 :]


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one array a task, summed by bucket; the driver gets a row a bucket."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        crc, total = RunningCrc(), np.zeros(buckets, np.int64)
        for part in parts:
            for at, _ in features(part["body"].tolist(), crc, buckets):
                total += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    rows = texts.select(body(F.col(f"`{text}`")).alias("body")).mapInPandas(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target to raw probability by bucket, with one added to each count, rounded down."""
    buckets = len(raw)
    n_raw, n_target = float(raw.sum() + buckets), float(target.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * n_raw / ((s + 1) * n_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(text: Column, gain: np.ndarray) -> Column:
    """``n_features`` and ``weight`` (sum of their gains) of a text."""

    @F.pandas_udf("n_features bigint, weight bigint")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crc, value = RunningCrc(), gain.astype(np.float64)
        for part in parts:
            n, weight = np.zeros(len(part), np.int64), np.zeros(len(part))
            for at, owner in features(part.tolist(), crc, len(gain)):
                n += np.bincount(owner, minlength=len(part))
                weight += np.bincount(owner, value[at], minlength=len(part))  # whole numbers, so exact
            yield pd.DataFrame({"n_features": n, "weight": weight.astype(np.int64)})

    return of(body(text))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise, rounded down, from the first 32 bits of a hash of seed and id; null for a null id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


# ------------------------------------------------------------ radix sort


def _digits(low: int, high: int, c: Column, descending: bool) -> list[Column]:
    """Digits of a key, least first, as far as keys between ``low`` and ``high`` differ in them."""
    if high - low < 1 << 63:
        bits, value = (high - low).bit_length(), (F.lit(high) - c) if descending else (c - F.lit(low))
    else:  # the difference has no long: all bits, with the sign turned
        bits, value = 64, c.bitwiseXOR(F.lit(-1 << 63))
        value = F.bitwise_not(value) if descending else value
    mask = F.lit((1 << DIGIT_BITS) - 1).cast("bigint")
    return [F.shiftrightunsigned(value, at).bitwiseAND(mask).cast("int") for at in range(0, bits, DIGIT_BITS)]


def radix_ranks(df: DataFrame, order: Sequence[tuple[str, bool]], rank: str = "rank") -> DataFrame:
    """``df`` with ``rank`` 1, 2, 3 ... by the whole-number columns of ``order`` (each with True for descending), first the most significant.

    Equal rows get different ranks in any order. Rows with a null in ``order`` have no rank (null). Each pass reads and
    writes a table in the shared folder, so lost executors cost one pass at most.
    """
    (name,) = fresh(df, rank)
    keys = [f"_k{i}" for i in range(len(order))]
    rows = df.select(F.struct(*plain(df)).alias("_row"), *[F.col(f"`{c}`").cast("bigint").alias(k) for (c, _), k in zip(order, keys, strict=True)])
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    whole = written(rows.withColumn("_chunk", F.spark_partition_id().cast("bigint")).withColumn("_at", F.monotonically_increasing_id()), "radix")
    table = whole.where(complete)
    ends = table.agg(F.count(F.lit(1)).alias("n"), *[f(k).alias(f"{k}_{f.__name__}") for k in keys for f in (F.min, F.max)]).first()
    if ends["n"]:
        chunk_rows = min(CHUNK_ROWS, max(1, -(-ends["n"] // (4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
        for k, (_, descending) in reversed(list(zip(keys, order, strict=True))):
            for digit in _digits(ends[f"{k}_min"], ends[f"{k}_max"], F.col(k), descending):
                table = _pass(table.withColumn("_digit", digit), chunk_rows)
    # the least key may not differ at all; places are then those of the table, which have gaps between partitions
    dense = table if "_dense" in table.columns else _pass(table.withColumn("_digit", F.lit(0)), max(1, ends["n"]))
    out = dense.select("_row.*", (F.col("_at") + 1).alias(name))
    return out.unionAll(whole.where(~complete).select("_row.*", F.lit(None).cast("bigint").alias(name)))


def _pass(table: DataFrame, chunk_rows: int) -> DataFrame:
    """One stable counting sort by ``_digit``: the table with new places ``_at`` from 0 on, in chunks of so many places."""
    counts = written(table.groupBy("_chunk", "_digit").agg(F.count(F.lit(1)).alias("_n")), "radix-counts")
    totals = sorted(counts.groupBy("_digit").agg(F.sum("_n").alias("n")).collect())  # at most 2 ** DIGIT_BITS rows
    starts, at = [], 0
    for digit, n in totals:
        starts.append((digit, at))
        at += n
    earlier = Window.partitionBy("_digit").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = F.broadcast(table.sparkSession.createDataFrame(starts, "_digit int, _start bigint"))
    offsets = counts.join(first, "_digit").select("_chunk", "_digit", (F.col("_start") + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_chunk", "_digit").orderBy("_at")) - 1
    moved = table.join(offsets, ["_chunk", "_digit"]).withColumn("_at", F.col("_offset") + inside)
    moved = moved.withColumn("_chunk", F.floor(F.col("_at") / chunk_rows).cast("bigint"))
    return written(moved.drop("_digit", "_offset").withColumn("_dense", F.lit(True)), "radix")


# ------------------------------------------------------------ the operator


def weigh(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``n_features``, ``weight`` and ``score``. No document is moved.

    Null and empty texts have no features, weight 0 and a score; a null id has no score. Very long texts are taken piece
    by piece. An empty ``target`` gives gains from the raw counts alone, an empty ``docs`` an empty table. If ``docs`` has
    columns of these names, the new ones get an underscore more.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    n_features, weight, score = fresh(docs, "n_features", "weight", "score")
    rated = docs.select(F.struct(*plain(docs)).alias("_row"), F.col(f"`{doc_id}`").alias("_id"), weighed(F.col(f"`{text}`"), gain).alias("_w"))
    return rated.select("_row.*", F.col("_w.n_features").alias(n_features), F.col("_w.weight").alias(weight), (F.col("_w.weight") + noise(F.col("_id"), seed)).alias(score))


def draw(scored: DataFrame, doc_id: str = "doc_id", score: str = "score", n_features: str = "n_features", percent: int = PERCENT, least_words: int = LEAST_WORDS, rank: str = "rank") -> DataFrame:
    """``scored`` with ``rank`` 1, 2, 3 ... of the rows drawn, null for others.

    Of the rows with at least ``least_words`` words ``percent`` are drawn, rounded down: those of the highest scores, of
    equal scores those of the smaller id. Rows without id or score are neither drawn nor counted. Repeated rows take part
    each for itself; equal ids with equal scores are ranked in any order. All columns of ``scored`` move in each pass of
    the sort, so give it narrow rows and join texts to the sample.
    """
    (name,) = fresh(scored, rank)
    (key,) = fresh(scored, "_key")
    least = sum(max(0, least_words - back) for back in range(RUN))  # n words have n + (n - 1) + (n - 2) features
    may = scored.withColumn(key, F.when(F.col(f"`{n_features}`") >= least, F.col(f"`{score}`")))
    ranked = written(radix_ranks(may, [(key, True), (doc_id, False)], name).drop(key), "ranked")
    drawn = percent * ranked.where(F.col(f"`{name}`").isNotNull()).count() // 100
    return ranked.withColumn(name, F.when(F.col(f"`{name}`") <= drawn, F.col(f"`{name}`")))


def sample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The documents drawn, whole; of documents with equal ids all are taken if one is drawn."""
    rated = weigh(docs, target, doc_id, **options)
    score, n_features = rated.columns[-1], rated.columns[-3]
    ids = draw(rated.select(F.col(f"`{doc_id}`"), *plain(rated, n_features, score)), doc_id, score, n_features)
    ids = ids.where(F.col(f"`{ids.columns[-1]}`").isNotNull()).select(F.col(f"`{doc_id}`").alias("_drawn")).distinct()
    return docs.join(ids, F.col(f"`{doc_id}`") == F.col("_drawn"), "left_semi")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return draw(weigh(docs.select("doc_id", "text"), benchmark).drop("text"))


#: For the check: the same by unnested features, with CRC-32 byte by byte from its table, and one global order.
SQL = r"""
WITH tbl AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
         lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
texts AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
runs AS (SELECT r, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS f FROM w, range(1, 4) k(n) WHERE len(w) >= n),
seen AS (SELECT r, f, count(*) AS n FROM runs GROUP BY ALL),
terms AS (SELECT f, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::UBIGINT)),
         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1]))) % 10000 AS bucket FROM (SELECT DISTINCT f FROM seen), tbl),
hits AS (SELECT r, bucket, sum(n) AS n FROM seen JOIN terms USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM hits GROUP BY bucket),
alls AS (SELECT coalesce(sum(s), 0) + 10000 AS s_all, coalesce(sum(t), 0) + 10000 AS t_all FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * s_all::DOUBLE / ((s + 1)::DOUBLE * t_all::DOUBLE)))::BIGINT AS gain FROM sums, alls),
weights AS (SELECT r, sum(n * gain) AS weight FROM hits JOIN gain USING (bucket) GROUP BY r),
d AS (SELECT r, doc_id, len(w) AS n_words, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features,
             coalesce(weight, 0) AS weight, ('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT AS h
      FROM w LEFT JOIN weights USING (r) WHERE r > 0),
e AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d),
p AS (SELECT *, CASE WHEN n_words >= 20 AND score IS NOT NULL THEN row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) END AS place,
             count(*) FILTER (n_words >= 20 AND score IS NOT NULL) OVER () AS n FROM e)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank FROM p
"""
