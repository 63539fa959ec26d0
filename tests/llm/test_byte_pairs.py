import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import byte_pairs
from tidemark.llm.queries import table, vocabulary

PATH = vocabulary(byte_pairs.VOCABULARY)
KIND = "doc_id bigint, text string, ids string, raw int"


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_pairs.Coder(PATH, public_tokenizers.PATTERN)


def want(library, docs):
    out = []
    for doc, text in docs:
        ids = library.encode_ordinary(text or "")
        digests = (hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        out.append((doc, len(ids), *digests))
    return sorted(out, key=str)


def got(docs):
    return sorted(map(tuple, byte_pairs.digest(docs, PATH).collect()), key=str)


def test_all_documents(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    assert got(docs) == want(library, [(r.doc_id, r.text) for r in docs.collect()])


def odd_texts():
    rng = random.Random(0)
    letters, wide = "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上国日本語한국어привет мир สวัสดีชาวโลก"
    texts = [None, "", " ", "\n" * 50, " " * 3000, "a" * 5000, "don't can'T '", "\u0000\u0001", "🙂👩‍👩‍👧‍👦" * 30, "é" * 700, "<|endoftext|>", "0" * 400]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (47, 48, 49, 300, 3000)]
    texts += ["".join(rng.choice(wide) for _ in range(n)) for n in (20, 400, 2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x800), rng.randrange(0x3000, 0xA000)])) for _ in range(200)) for _ in range(30)]
    return texts


def test_odd_rows(spark, library):
    docs = [(i if i != 3 else None, t) for i, t in enumerate(odd_texts())] * 2
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], KIND).repartition(3)
    assert got(frame) == want(library, docs)
    assert got(frame.limit(0)) == []


def test_small_blocks(monkeypatch, library, coder):
    texts = [t.encode() if t is not None else None for t in odd_texts()]
    for name, value in (("TEXT_BLOCK", 200), ("TOKEN_BLOCK", 7), ("QUERY_BYTES", 30), ("KEPT_WORDS", 50)):
        monkeypatch.setattr(byte_pairs, name, value)
    ids, counts = coder.encode(texts)
    ends = counts.cumsum()
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [library.encode_ordinary((t or b"").decode()) for t in texts]
    some = slice(0, int(ends[4]))
    assert coder.decode(ids[some], counts[:5]) == [t or b"" for t in texts[:5]]


def test_recursion_equals_heap(coder):
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abcest ing") for _ in range(rng.randrange(1, 40))) for _ in range(2000)] + [bytes(rng.randrange(256) for _ in range(60))]
    ids, counts = coder._contracted(words)
    ends = counts.cumsum()
    for word, end, n in zip(words, ends, counts, strict=True):
        assert ids[end - n : end].tolist() == byte_pairs.contracted_by_heap(word, coder.ranks).tolist()


def test_unknown_id(coder):
    import numpy as np

    with pytest.raises(ValueError):
        coder.decode(np.array([60_000]), np.array([1]))


def test_columns_alone(spark, library):
    texts = [(t,) for t in odd_texts()[:8]]
    ids = spark.createDataFrame(texts, "text string").select("text", byte_pairs.encode("text", PATH).alias("ids"))
    rows = ids.select("text", "ids", byte_pairs.decode("ids", PATH).alias("raw")).collect()
    assert all(list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.raw) == (r.text or "").encode() for r in rows)
