"""Byte-level BPE: encoding by recursive queries over token positions, decoding by ordered aggregation, both in DuckDB inside each task.

A text is cut by the tokenizer's pattern. A word that is a token by itself is done; the others become rows (word, position,
token), which a recursive query joins with the merge table: each step contracts every word's leftmost pair of the least
rank, until no pair of any word is in the table. A task keeps the words that it has met, so each is contracted once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, worker_state

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Words that a worker process keeps (some 100 MB); beyond it those met once since the last time go.
KEPT_WORDS = 300_000
#: Characters encoded and tokens decoded at a time, and bytes of new words in one recursive query.
TEXT_BLOCK, TOKEN_BLOCK, QUERY_BYTES = 2_000_000, 250_000, 250_000
#: Texts of an Arrow batch taken at a time.
SLICE = 2500
#: Words over CUT bytes are cut where no token can lie across; stretches over LONG bytes are contracted by a heap, as
#: the recursion takes a step for each contraction.
CUT, LONG = 48, 256  # LONG is below 1024, the places that CONTRACT has room for

#: A row's place is its word times 1024 plus its position, so one order serves all words.
CONTRACT = """
WITH RECURSIVE t(place, id, done) AS (
  SELECT w::BIGINT * 1024 + pos, id, false FROM fresh
  UNION ALL
  (WITH p AS MATERIALIZED (SELECT place, id, lead(id) OVER win AS next, lead(place) OVER win AS after, lag(place) OVER win AS before
                           FROM t WHERE NOT done WINDOW win AS (ORDER BY place)),
   best AS (SELECT place >> 10 AS w, min(r::BIGINT * 1024 + (place & 1023)) AS least FROM p JOIN merges m ON p.id = m.a AND p.next = m.b
            WHERE after >> 10 = place >> 10 GROUP BY 1)
   SELECT p.place, CASE WHEN p.place & 1023 = least & 1023 THEN least >> 10 ELSE p.id END, least IS NULL
   FROM p LEFT JOIN best ON p.place >> 10 = best.w
   WHERE least IS NULL OR p.before IS DISTINCT FROM (best.w << 10) + (least & 1023)))
SELECT (place >> 10)::INTEGER AS w, id FROM t WHERE done ORDER BY place
"""
EXPAND = "SELECT doc, list(raw ORDER BY pos) AS raw FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


class Coder:
    """Encoder and decoder of one vocabulary, with the words that it has met."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.longest = max(map(len, self.ranks))
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cut = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, r = (pa.array(np.array(c, np.int32)) for c in zip(*pairs, strict=True))
        self._load("merges", pa.table({"a": a, "b": b, "r": r}))
        ids = pa.array(np.array(list(self.ranks.values()), np.int32))
        self._load("vocabulary", pa.table({"id": ids, "raw": pa.array(list(self.ranks), pa.binary())}))
        self.known = np.zeros(max(self.ranks.values()) + 1, bool)
        self.known[list(self.ranks.values())] = True
        self._start()

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("_rows", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM _rows")
        self.db.unregister("_rows")

    def _start(self) -> None:
        """At first whole tokens are the words known."""
        words = {t: r for t, r in self.ranks.items() if _is_text(t)}
        self.numbers = {t.decode(): i for i, t in enumerate(words)}
        self.flat = np.array(list(words.values()), np.int32)
        self.starts = np.arange(len(words), dtype=np.int64)
        self.counts = np.ones(len(words), np.int64)
        self.used, self.tokens = np.zeros(len(words), np.int64), len(words)

    def _forget(self) -> None:
        """Keep whole tokens and, of the other words, those met most often."""
        least, keep = 1, np.ones(len(self.counts), bool)
        while keep.sum() - self.tokens > KEPT_WORDS // 2:
            least *= 2
            keep = self.used >= least
            keep[: self.tokens] = True
        counts = self.counts[keep]
        at = np.repeat(self.starts[keep] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        new = np.cumsum(keep) - 1
        self.numbers = {w: int(new[i]) for w, i in self.numbers.items() if keep[i]}
        self.flat, self.starts, self.counts, self.used = self.flat[at], np.cumsum(counts) - counts, counts, np.zeros(len(counts), np.int64)

    # ------------------------------------------------------------ encoding

    def _stretches(self, word: bytes) -> list[bytes]:
        """The word, cut at places that no token in it spans: no contraction can cross them."""
        if len(word) <= CUT:
            return [word]
        cuts, reach = [0], 0
        for start in range(len(word)):
            if start and start >= reach:
                cuts.append(start)
            for end in range(min(len(word), start + self.longest), max(start + 1, reach), -1):
                if word[start:end] in self.ranks:
                    reach = end
                    break
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]

    def _contracted(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all parts, from their single bytes, and their number for each part."""
        size = np.array([len(p) for p in parts])
        blocks = np.cumsum(size) // QUERY_BYTES
        ids, counts = [], []
        for some in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(blocks)) + 1):
            n = size[some]
            w = np.repeat(np.arange(len(some), dtype=np.int32), n)
            pos = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            raw = np.frombuffer(b"".join(parts[some[0] : some[-1] + 1]), np.uint8)
            self.db.register("fresh", pa.table({"w": w, "pos": pos, "id": self.byte[raw]}))
            out = self.db.sql(CONTRACT).to_arrow_table()
            self.db.unregister("fresh")
            ids.append(out.column("id").to_numpy())
            counts.append(np.bincount(out.column("w").to_numpy(), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(counts)

    def _keep(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.numbers.update(zip(words, range(len(self.counts), len(self.counts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])
        self.flat = np.concatenate([self.flat, ids.astype(np.int32)])

    def _learn(self, words: list[str]) -> None:
        """Contract new words and keep their tokens."""
        raw = [w.encode() for w in words]
        short = [i for i, r in enumerate(raw) if len(r) <= CUT]
        if short:
            self._keep([words[i] for i in short], *self._contracted([raw[i] for i in short]))
        long = [i for i, r in enumerate(raw) if len(r) > CUT]
        if not long:
            return
        cut = [self._stretches(raw[i]) for i in long]
        parts = list(dict.fromkeys(p for some in cut for p in some))
        found = {p: contracted_by_heap(p, self.ranks) for p in parts if len(p) > LONG}
        if some := [p for p in parts if len(p) <= LONG]:
            ids, counts = self._contracted(some)
            found.update(zip(some, np.split(ids, np.cumsum(counts)[:-1]), strict=True))
        tokens = [found[p] for some in cut for p in some]
        self._keep([words[i] for i in long], np.concatenate(tokens), np.array([sum(len(found[p]) for p in some) for some in cut]))

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words in one array, and their number for each word."""
        if len(self.numbers) - self.tokens > KEPT_WORDS:
            self._forget()
        fresh = [w for w in dict.fromkeys(words) if w not in self.numbers]
        if fresh:
            self._learn(fresh)
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        self.used += np.bincount(at, minlength=len(self.used))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.flat[np.repeat(self.starts[at] - (ends - counts), counts) + np.arange(int(counts.sum()))], counts

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= TEXT_BLOCK:
            yield self.cut.findall(text)
            return
        found = self.cut.finditer(text)
        while part := [m.group() for m in islice(found, TEXT_BLOCK // 8)]:
            yield part

    def encode(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts in one array, and their number for each text."""
        counts, out, words, owner, size = np.zeros(len(texts), np.int64), [], [], [], 0

        def flush():
            ids, n = self._ids(words)
            out.append(ids)
            np.add.at(counts, [i for i, _ in owner], np.add.reduceat(np.append(n, 0), np.cumsum([0, *[k for _, k in owner]])[:-1]))
            words.clear()
            owner.clear()

        for i, text in enumerate(texts):
            for part in self._pieces((text or b"").decode("utf-8", "replace")):
                if part:
                    words.extend(part)
                    owner.append((i, len(part)))
                if len(words) >= TEXT_BLOCK // 8:
                    flush()
        if words:
            flush()
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    # ------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text from its tokens."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        out: list[list[bytes]] = [[] for _ in counts]
        for at in range(0, len(ids), TOKEN_BLOCK):
            some = slice(at, at + TOKEN_BLOCK)
            part = pa.table({"doc": doc[some], "pos": np.arange(len(ids[some]), dtype=np.int32), "id": ids[some].astype(np.int32)})
            self.db.register("tokens", part)
            made = self.db.sql(EXPAND).to_arrow_table()
            self.db.unregister("tokens")
            for d, chunk in zip(made.column("doc").to_pylist(), _joined(made.column("raw").combine_chunks()), strict=True):
                out[d].append(chunk)
        return [b"".join(parts) for parts in out]


def _joined(lists: pa.Array) -> Iterator[bytes]:
    """The parts of each list of bytes, joined: they lie one after another in one buffer."""
    values = lists.values
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    buffer, at = memoryview(values.buffers()[2]), ends[lists.offsets.to_numpy()]
    return (bytes(buffer[a:b]) for a, b in pairwise(at.tolist()))


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


def contracted_by_heap(word: bytes, ranks: dict[bytes, int]) -> np.ndarray:
    """The same contraction for a very long stretch: always the least rank, of equal ranks the leftmost pair."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n))  # of the token that starts here; where the one before it starts
    heap = [(ranks[word[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or end[i] != j or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, stop, end[stop]))
        if i and (r := ranks.get(word[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], i, stop))
    return np.array([ranks[word[i : end[i]]] for i in range(n) if alive[i]], np.int32)


def _coder(path: str, pattern: str) -> Coder:
    state = worker_state()
    if (path, pattern) not in state:
        state[path, pattern] = Coder(path, pattern)
    return state[path, pattern]


def cut_pattern() -> str:
    """The pattern by which the public vocabularies cut texts."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def _slices(batch: pa.Array) -> Iterator[pa.Array]:
    return (batch.slice(at, SLICE) for at in range(0, max(len(batch), 1), SLICE))


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids, pa.int32()))


def encode(text: Column | str, path: str, pattern: str | None = None) -> Column:
    """Token ids of whole texts. Null and empty texts have none; bytes that are no UTF-8 count as U+FFFD. Very long texts are taken
    in blocks of words, equal texts have equal ids."""
    pattern = pattern or cut_pattern()

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([_lists(*_coder(path, pattern).encode(part.to_pylist())) for part in _slices(batch)])

    return ids_of(body(text))


def decode(ids: Column | str, path: str, pattern: str | None = None) -> Column:
    """The bytes of texts from their token ids; none for null and for an empty list. An id outside the vocabulary is an error."""
    pattern = pattern or cut_pattern()

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for part in _slices(batch):
                counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                out += _coder(path, pattern).decode(part.flatten().to_numpy(zero_copy_only=False), counts)
            yield pa.array(out, pa.binary())

    return bytes_of(ids)


def round_trip(text: Column | str, path: str, pattern: str | None = None) -> Column:
    """``ids`` as ``encode`` gives them and ``raw`` as ``decode`` makes of these, by one worker process instead of two in a row."""
    pattern = pattern or cut_pattern()

    @F.arrow_udf("ids array<int>, raw binary")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lists, out = [], []
            for part in _slices(batch):
                ids, counts = _coder(path, pattern).encode(part.to_pylist())
                lists.append(_lists(ids, counts))
                out += _coder(path, pattern).decode(ids, counts)
            yield pa.StructArray.from_arrays([pa.concat_arrays(lists), pa.array(out, pa.binary())], ["ids", "raw"])

    return both(body(text))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """A row for each document; repeated rows keep one each, extra columns take no part."""
    both = docs.select("doc_id", round_trip("text", path).alias("_both")).select("doc_id", "_both.ids", "_both.raw")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("raw", 256).alias("decoded_sha256"),
    )
