"""Benchmark decontamination: which words of a document lie in a window of a benchmark item.

A prefix-filtered join. A window of consecutive item words occurs in a document only if all of its shingles do, so of
its shingles, ordered by rarity in the documents, the first one is a sufficient prefix: documents are probed for that
shingle alone. Its place in the window gives the only possible start, the window's length bounds it on both sides, and
the words between are then compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, fresh, plain
from tidemark.session import written

WINDOW = 13
SHINGLE = 3
#: Benchmark words in one broadcast index (some 100 MB at the worst); a larger benchmark is taken in several blocks of items.
INDEX_WORDS = 500_000
#: Fixed by the definition of a word: lower-cased A-Z, digits and everything outside ASCII.
_WORD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD).split()


@dataclass
class Index:
    """Windows of a block of items: as word numbers, with the shingles of each and the items it belongs to."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[bytes, list[str | None]] = field(default_factory=dict)
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    at: dict[tuple[int, int], list[tuple[int, int, bytes]]] = field(default_factory=dict)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)  # 0: in no item

    def keys(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Places where ``width`` known words stand together, and the number each such shingle has."""
        n, base = len(ids) - width + 1, len(self.vocabulary) + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(width):
            part = ids[i : i + n]
            key, known = key * base + part, known & (part > 0)
        at = np.flatnonzero(known)
        return at, key[at]

    def shingles_of(self, window: bytes) -> tuple[int, np.ndarray]:
        ids = np.frombuffer(window, np.int64)
        width = min(SHINGLE, len(ids))
        return width, self.keys(ids, width)[1]


def _index(items: list[tuple[str | None, bytes | None]], length: int) -> Index:
    index = Index()
    for item, text in items:
        words = words_of(text)
        for w in words:
            index.vocabulary.setdefault(w, len(index.vocabulary) + 1)
        ids = index.numbers(words)
        for i in range(max(1, len(ids) - length + 1) if len(ids) else 0):
            owners = index.windows.setdefault(ids[i : i + length].tobytes(), [])
            if item not in owners:
                owners.append(item)
    by_width: dict[int, set[int]] = {}
    for window in index.windows:
        width, keys = index.shingles_of(window)
        by_width.setdefault(width, set()).update(keys.tolist())
    index.grams = {width: np.array(sorted(keys), np.int64) for width, keys in by_width.items()}
    return index


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``keys`` stand in ``sorted_keys``, and where."""
    slot = np.searchsorted(sorted_keys, keys)
    hit = np.flatnonzero(sorted_keys[np.minimum(slot, len(sorted_keys) - 1)] == keys) if len(sorted_keys) else np.zeros(0, np.int64)
    return hit, slot[hit]


def _with_prefixes(docs: DataFrame, text: str, index: Index) -> Index:
    """Counts, over all documents, how many hold each shingle of the index, and keys each window by its rarest."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = {width: np.zeros(len(keys), np.int64) for width, keys in index.grams.items()}
        for part in parts:
            for t in part["body"]:
                ids = index.numbers(words_of(t))
                for width, keys in index.grams.items():
                    seen[width][np.unique(_found(keys, index.keys(ids, width)[1])[1])] += 1
        for width, n in seen.items():
            some = np.flatnonzero(n)
            yield pd.DataFrame({"width": width, "slot": some, "n": n[some]})

    rows = docs.select(body(F.col(f"`{text}`")).alias("body")).mapInPandas(count, "width int, slot bigint, n bigint").groupBy("width", "slot").agg(F.sum("n").alias("n"))
    rarity = {(r["width"], r["slot"]): r["n"] for r in rows.collect()}  # one number for each shingle of the index at most
    for window in index.windows:
        width, keys = index.shingles_of(window)
        slots = np.searchsorted(index.grams[width], keys).tolist()
        rarest = min(range(len(slots)), key=lambda i: (rarity.get((width, slots[i]), 0), slots[i], i))
        index.at.setdefault((width, slots[rarest]), []).append((rarest, len(window) // 8, window))
    index.grams = {width: index.grams[width][sorted(s for w, s in index.at if w == width)] for width in index.grams}
    renumber = {width: {s: i for i, s in enumerate(sorted(s for w, s in index.at if w == width))} for width in index.grams}
    index.at = {(width, renumber[width][s]): v for (width, s), v in index.at.items()}
    return index


def _hits(words: list[bytes], index: Index) -> tuple[list[int], list[str]]:
    """Merged spans of hit words, flat as start, end, start, end, ...; and the items found."""
    ids = index.numbers(words)
    flat, spans, items = ids.tobytes(), [], set()
    for width, keys in index.grams.items():
        places, found = index.keys(ids, width)
        hit, slots = _found(keys, found)
        for place, slot in zip(places[hit].tolist(), slots.tolist(), strict=True):
            for offset, length, window in index.at[width, slot]:
                start = place - offset
                if start >= 0 and start + length <= len(words) and flat[8 * start : 8 * (start + length)] == window:
                    spans.append((start, start + length))
                    items.update(index.windows[window])
    merged: list[int] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [start, end]
    return merged, sorted(i for i in items if i is not None)


FIELDS = "n_words bigint, spans array<bigint>, items array<string>"


def _finder(index: Index) -> Column:
    @F.pandas_udf(FIELDS)
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                words = words_of(t)
                rows.append((len(words), *_hits(words, index)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return find.asNondeterministic()  # so that filters never run it twice


def _union(spans: Column) -> Column:
    def one(flat) -> list[int]:
        merged: list[int] = []
        for start, end in sorted(zip(flat[::2], flat[1::2], strict=True)):
            if merged and start <= merged[-1]:
                merged[-1] = max(merged[-1], int(end))
            else:
                merged += [int(start), int(end)]
        return merged

    @F.pandas_udf("array<bigint>")
    def union(spans: pd.Series) -> pd.Series:
        return spans.map(one)

    return union(spans)


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, index_words: int = INDEX_WORDS) -> tuple[DataFrame, str]:
    """``docs`` with one struct column more, and its name: ``n_words``, ``spans`` (flat word spans covered) and ``items``.

    Null and empty texts have no words and no spans; items without words have no windows; an item without id counts for
    spans and is in no list. Equal ids count once. Repeated documents are rows of their own. A benchmark of more than
    ``index_words`` words is taken in blocks of items: all documents are scanned for one block after another, each
    with an index of bounded size, and a document's spans are united.
    """
    (name,) = fresh(docs, "_hits")
    listed = items.select(F.col(f"`{item_id}`").cast("string").alias("item"), body(F.col(f"`{item_text}`")).alias("body"))
    size = listed.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("n")).first()["n"] // 2 + 1  # words at most
    blocks = -(-size // index_words)
    block_of = F.pmod(F.xxhash64("item", "body"), F.lit(blocks))

    def found(source: DataFrame, k: int) -> Column:
        rows = [(r["item"], r["body"] and bytes(r["body"])) for r in listed.where(block_of == k).collect()]  # a bounded block
        return _finder(_with_prefixes(source, text, _index(rows, window)))(body(F.col(f"`{text}`")))

    if blocks == 1:
        return docs.select(*plain(docs), found(docs, 0).alias(name)), name
    (row,) = fresh(docs, "_row")
    kept = written(docs.select(*plain(docs), F.monotonically_increasing_id().alias(row)), "decontaminate-rows")
    each = [written(kept.select(F.col(row).alias("_of"), found(kept, k).alias("h")), "decontaminate-block") for k in range(blocks)]
    every = each[0]
    for more in each[1:]:
        every = every.unionByName(more)
    united = every.groupBy("_of").agg(F.max("h.n_words").alias("n"), F.flatten(F.collect_list("h.spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("h.items")))).alias("i"))
    hits = united.select("_of", F.struct(F.col("n").alias("n_words"), _union(F.col("s")).alias("spans"), F.col("i").alias("items")).alias(name))
    return kept.join(hits, kept[row] == hits["_of"]).select(*plain(docs), name), name


def n_hit(name: str) -> Column:
    """Words covered by the flat spans: ends (odd places) less starts."""
    signed = F.transform(F.col(f"{name}.spans"), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("bigint"), lambda a, x: a + x)


def contaminated(name: str) -> Column:
    return (n_hit(name) > 0) & (20 * n_hit(name) >= F.col(f"{name}.n_words"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    hits, h = contamination(docs, items)
    ids = F.col(f"{h}.items")
    return hits.select(
        "doc_id", F.col(f"{h}.n_words").alias("n_words"), n_hit(h).alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), contaminated(h).alias("contaminated"),
    )


#: For the check: windows as word lists, all of them compared at each place.
SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least(13, len(w)) - 1] AS w
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
lens AS (SELECT DISTINCT len(w) AS n FROM win),
heads AS (SELECT DISTINCT w[1] AS head FROM win),
one AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
spot AS (SELECT d.r, one.i, lens.n, d.w[one.i:one.i + lens.n - 1] AS w FROM one JOIN heads ON one.word = heads.head JOIN d ON one.r = d.r CROSS JOIN lens WHERE one.i + lens.n - 1 <= len(d.w)),
m AS (SELECT spot.r, spot.i, spot.n, win.item_id FROM spot JOIN win ON spot.w = win.w),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
