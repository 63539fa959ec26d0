"""Packing by vector bin packing: examples go into sequences under limits on tokens, segments and loss-bearing tokens.

Each partition of the documents is packed by itself, a bounded pool of pieces at a time, so no row is shuffled. The
next piece for an open sequence is the one whose needs have the largest dot product with the room left in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, worker_state

VOCABULARY = "word_bpe_49k.json"
END = 2
LENGTH = 4096
#: Parts of words whose ids a worker process keeps (some 100 MB); when there are more it begins anew.
CACHE_PARTS = 600_000
#: Bytes of text whose words are numbered together: the more, the fewer different words there are for each byte.
SLICE_BYTES = 8 << 20
#: Pieces that wait for a sequence in one task: as many as give the heuristic a choice, and few enough for memory.
POOL = 512


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""

    tokens: int = LENGTH
    segments: int = 512
    loss: int = LENGTH

    def array(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss], np.int64)


def spaced(words: pa.Array) -> bytes:
    """The words with a space between."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.scalar(b" ", words.type))[0].as_py()


class WordTokenizer:
    """Ids of whole texts, word by word: no token of this vocabulary spans white space.

    A slice of texts is cut into words and these are numbered by Arrow, so only different words are looked at. They
    are cut into parts as the tokenizer cuts them; the ids of parts, of which there are far fewer than words, are kept
    for later slices. Ids of texts are then gathered by word number. Words in which white space or special
    tokens might hide go through the whole tokenizer one by one.
    """

    #: The tokenizer's own cut of a text.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        import tokenizers

        self.encoder = tokenizers.Tokenizer.from_file(path)
        self.merge = self.encoder.model.tokenize
        self.bytes_as_letters = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.cut = regex.compile(self.PARTS + "| ").findall
        spaces = b"|".join(chr(i).encode() for i in range(0x80, 0x3001) if chr(i).isspace() or i == 0x180E)
        self.odd = regex.compile(rb"[\x00-\x1F\x7F]|<\||" + spaces).search
        # a worker process runs one task after another, and what it has learned holds for all of them
        self.kept: dict[str, bytes] = worker_state().setdefault("packing", {}).setdefault(path, {})

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            codes = self.encoder.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            out += [np.array(c.ids, "<u4").tobytes() for c in codes]
        return out

    def _learn(self, parts: set[str]) -> None:
        """Keeps the ids of parts, each with one call of the merges."""
        plain = [p for p in parts if p.isascii()]
        other = [p for p in parts if not p.isascii()]
        letters = self.bytes_as_letters(" ".join(other))[0][0].split("\u0120") if other else []  # a space as a letter
        ids, stops = [], []
        for p in plain + letters:
            ids += [t.id for t in self.merge(p)]
            stops.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        self.kept.update((p, raw[s:e]) for p, s, e in zip(plain + other, [0, *stops], stops, strict=False))

    def _together(self, text: str, words: int) -> tuple[bytes, np.ndarray] | None:
        """Ids of normalised words with a space between, and the number of each word's ids; None if the words can't be told apart."""
        found = self.cut(text)
        parts = set(found) - {" "}
        if len(self.kept) + len(parts) > CACHE_PARTS:
            self.kept.clear()
        self._learn(parts - self.kept.keys())
        self.kept[" "] = b""
        data = [self.kept[p] for p in found]
        sizes = np.fromiter(map(len, data), np.int64, len(data)) // 4
        gaps = np.flatnonzero(sizes == 0)
        if len(gaps) != words - 1:
            return None
        before = np.concatenate([[0], np.cumsum(sizes)])
        return b"".join(data), np.diff(before[np.concatenate([[0], gaps, [len(data)]])])

    def _words(self, words: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Ids of different words in one string, and where each word's begin and how many they are."""
        n = len(words)
        joined = spaced(words)
        letters = np.frombuffer(joined, np.uint8)
        lengths = np.diff(np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + n + 1])
        special = np.flatnonzero((letters >= 0x7F) | (letters < 0x20) | (letters == ord("<")))
        other = np.zeros(n, bool)
        other[np.searchsorted(np.cumsum(lengths + 1), special, "right")] = True
        order, rest = np.flatnonzero(~other), words.filter(pa.array(other)).to_pylist()
        odd = np.array([self.odd(w) is not None for w in rest], bool)
        wide = [w for w, o in zip(rest, odd, strict=True) if not o]
        raw, sizes, places = [], [], []
        # letters of ASCII have one normal form; others are normalised together
        simple = words.filter(pa.array(~other))
        groups = [(spaced(simple).lower().decode(), order, simple.to_pylist)]
        groups.append((self.encoder.normalizer.normalize_str(b" ".join(wide).decode("utf-8", "replace")) if wide else "", np.flatnonzero(other)[~odd], lambda: wide))
        groups.append((None, np.flatnonzero(other)[odd], lambda: [w for w, o in zip(rest, odd, strict=True) if o]))
        for text, at, plain in groups:
            if not len(at):
                continue
            made = self._together(text, len(at)) if text is not None else None
            if made is None:
                codes = self._one_by_one(plain())
                made = b"".join(codes), np.array([len(c) // 4 for c in codes], np.int64)
            raw.append(made[0])
            sizes.append(made[1])
            places.append(at)
        size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if places:
            at, all_sizes = np.concatenate(places), np.concatenate(sizes)
            size[at], start[at] = all_sizes, np.cumsum(all_sizes) - all_sizes
        return b"".join(raw), start, size

    def _slice(self, texts: list[bytes]) -> list[bytes]:
        lists = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = lists.flatten().view(pa.large_binary()).dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        raw, start, size = self._words(coded.dictionary)
        number = coded.indices.to_numpy()
        many = size[number]
        stops = np.cumsum(many)
        places = np.repeat(start[number] - stops + many, many) + np.arange(stops[-1])
        ids = np.frombuffer(raw, "<u4")[places].tobytes()
        ends = np.concatenate([[0], stops])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * 4
        return [ids[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; none for null."""
        out, some, size = [], [], 0
        for t in texts:
            if some and size + len(t or b"") > SLICE_BYTES:
                out += self._slice(some)
                some, size = [], 0
            some.append(t or b"")
            size += len(t or b"")
        return out + self._slice(some) if some else out


def choose(needs: np.ndarray, waits: np.ndarray, room: np.ndarray, scale: np.ndarray) -> int:
    """The waiting piece that fits in every limit and has the largest dot product with the room (both as shares of the limits); -1 if none fits."""
    fits = waits & (needs <= room).all(1)
    if not fits.any():
        return -1
    score = (needs / scale) @ (room / scale)
    return int(np.argmax(np.where(fits, score, -1.0)))


@dataclass
class Packer:
    """Packs pieces as they come. ``close`` gives each finished sequence as a list of pieces in their order."""

    limits: Limits
    pool: int = POOL
    needs: list[tuple[int, int, int]] = field(default_factory=list)
    pieces: list[tuple] = field(default_factory=list)

    def add(self, piece: tuple, tokens: int, loss: int) -> Iterator[list[tuple]]:
        self.needs.append((tokens, 1, loss))
        self.pieces.append(piece)
        if len(self.pieces) >= self.pool:
            yield from self._pack(self.pool // 2)

    def close(self) -> Iterator[list[tuple]]:
        yield from self._pack(0)

    def _pack(self, leave: int) -> Iterator[list[tuple]]:
        """Fills one sequence after another until ``leave`` pieces wait."""
        scale = self.limits.array()
        needs = np.array(self.needs, np.int64).reshape(-1, 3)
        waits = np.ones(len(needs), bool)
        left = len(needs)
        while left > leave:
            room, bin_ = scale.copy(), []
            while (i := choose(needs, waits, room, scale)) >= 0:
                waits[i] = False
                room -= needs[i]
                bin_.append(self.pieces[i])
                left -= 1
            yield bin_
        self.pieces = [p for p, w in zip(self.pieces, waits, strict=True) if w]
        self.needs = [n for n, w in zip(self.needs, waits, strict=True) if w]


FIELDS = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def pack(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int = END, limits: Limits = Limits(), prompt: str | None = None, ids: bool = True) -> DataFrame:  # noqa: B008
    """A row for each piece of a document: its place in the document and in its sequence, and its ids (little-endian unsigned 32 bits).

    A document's ids are those of its text, then ``end``; a null or empty text has ``end`` alone. ``prompt`` names a
    column whose ids come before those of the text and bear no loss; without it all ids do. A document is cut only
    where it exceeds a limit by itself: full sequences are cut off its front, the rest is packed whole. Every task
    leaves one sequence partly filled at its end. Repeated rows are documents of their own. ``sequence_id`` is the task's
    partition times 2^36 plus a counter, so a task run again gives the same rows. Extra columns take no part.
    """
    id_kind = docs.schema[doc_id].dataType.simpleString()
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body(F.col(f"`{prompt}`") if prompt else F.lit(None).cast("string")).alias("prompt"), body(F.col(f"`{text}`")).alias("body"))
    piece_loss = min(limits.tokens, limits.loss)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, packer = WordTokenizer(path), Packer(limits)
        sequence, rows, stop = TaskContext.get().partitionId() << 36, [], int(end).to_bytes(4, "little")

        def out(bins):
            nonlocal sequence
            for b in bins:
                offset = 0
                for d, start, data, total in b:
                    n = len(data) // 4
                    rows.append((d, start, n, zlib.crc32(data), total, sequence, offset, data if ids else None))
                    offset += n
                sequence += 1

        def frame():
            made = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])
            rows.clear()
            if id_kind in ("bigint", "int"):
                made["doc_id"] = made["doc_id"].astype("Int64")
            return made

        def place(d, free: bytes, ids_: bytes):
            data = free + ids_ + stop
            total, at, no_loss = len(data) // 4, 0, len(free) // 4
            while at < total:
                skip = min(max(0, no_loss - at), limits.tokens)
                n = min(total - at, limits.tokens, skip + piece_loss)
                out(packer.add((d, at, data[4 * at : 4 * (at + n)], total), n, n - min(skip, n)))
                at += n

        for part in parts:
            free = encoder.encode(list(part["prompt"])) if prompt else [b""] * len(part)
            for d, before, after in zip(part["doc_id"].array, free, encoder.encode(list(part["body"])), strict=True):
                place(None if pd.isna(d) else d, before, after)
            yield frame()
        out(packer.close())
        yield frame()

    return source.mapInPandas(run, FIELDS.format(id=id_kind))


def digest(docs: DataFrame, path: str) -> DataFrame:
    return pack(docs, path, ids=False).drop("ids")
