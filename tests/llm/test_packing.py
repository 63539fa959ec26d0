import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.queries import table, vocabulary

PATH = vocabulary(packing.VOCABULARY)


def whole(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def check(rows, texts, limits):
    """Pieces put together are the documents; sequences have no gaps and keep every limit."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, text in texts.items():
        ids = [*whole(text), 2]
        pieces = sorted(by_doc.pop(d), key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s)])[:-1].tolist()
        assert sum(r.length for r in s) <= limits.tokens and len(s) <= limits.segments
    return sum(r.length for r in rows) / len(by_sequence) / limits.tokens


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fill = check(packing.digest(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()}, packing.Limits())
    assert fill > 0.97


def test_words_alone_give_the_ids_of_the_text():
    rnd, t, w = random.Random(2), Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)
    bits = ["a", "É", "é", "́", "'s", "'", " ", "\n", "\x0b", "\x1c", "\x85", " ", "<|endoftext|>", "<|", "Σ", "ς", "İ", "ß", "1", "23", "!!", "你好", "😀", "‍", "ﬁ", "K", "\x00", "'LL", "﻿", "　", "ſ"]
    for _ in range(800):
        texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 9))) for _ in range(rnd.choice([1, 3, 20]))]
        w.kept.clear()
        assert [np.frombuffer(x, "<u4").tolist() for x in w.encode([x.encode() for x in texts])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_all_limits_hold_at_once(spark):
    rows = [(i, "word " * (i % 50), "ask " * (i % 7)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, prompt string").coalesce(1)
    limits = packing.Limits(tokens=64, segments=3, loss=40)
    got = packing.pack(docs, PATH, limits=limits, prompt="prompt").collect()
    for s in {r.sequence_id for r in got}:
        mine = [r for r in got if r.sequence_id == s]
        loss = sum(max(0, r.start + r.length - max(r.start, r.doc_id % 7)) for r in mine)
        assert len(mine) <= 3 and sum(r.length for r in mine) <= 64 and loss <= 40
    for d, text, prompt in rows:
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in mine), "<u4").tolist()
        assert ids == [*whole(prompt), *whole(text), 2]


def test_choice_is_the_largest_dot_product():
    needs = np.array([[10, 1, 10], [60, 1, 5], [30, 1, 30], [70, 1, 1]])
    room, scale = np.array([60, 2, 20]), np.array([100, 4, 100])
    assert packing.choose(needs, np.ones(4, bool), room, scale) == 1
    assert packing.choose(needs, np.array([True, False, True, True]), room, scale) == 0
    assert packing.choose(needs, np.array([False, False, True, True]), room, scale) == -1


def test_edges(spark):
    texts = {1: None, 2: "", 3: "x " * 9000, 4: "z" * 50_000, 5: "same", 6: "same"}
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id bigint, text string, offset int")
    check(packing.digest(docs, PATH).collect(), texts, packing.Limits())
    again = docs.unionByName(docs).selectExpr("cast(null as bigint) as doc_id", "text")
    assert sum(r.length for r in packing.digest(again, PATH).collect()) == 2 * sum(len(whole(t)) + 1 for t in texts.values())
    assert packing.digest(docs.limit(0), PATH).count() == 0
    assert public_tokenizers.path(packing.VOCABULARY) == PATH
