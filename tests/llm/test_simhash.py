import random

import xxhash

from tidemark.llm import simhash
from tidemark.llm.graph import components
from tidemark.llm.queries import table


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(prints, radius=2):
    """Smallest id reachable, by comparing all with all."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if label[b] < label[a] and (prints[a] ^ prints[b]).bit_count() <= radius:
                    label[a], changed = label[b], True
    return label


def test_masks_cover_every_pair_of_bits():
    masks = simhash.masks(2)
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: r for r in simhash.digest(docs).collect()}
    prints = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute(prints)


def test_chains_hubs_and_near_misses(spark):
    rnd = random.Random(1)
    prints, base = {}, [rnd.getrandbits(64) for _ in range(4)]
    for i in range(400):
        x = rnd.choice(base)
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64 if i % 2 else 6)
        prints[i] = x
    for i in range(400, 440):  # a chain of steps of two bits
        prints[i] = ((1 << 2 * (i - 400)) - 1) & (2**64 - 1)
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in prints.items()]
    df = spark.createDataFrame(rows, "doc_id bigint, fp bigint").repartition(5)
    for radius in (0, 1, 2):
        got = {r.doc_id: r.component_id for r in simhash.groups(df, "doc_id", "fp", radius).collect()}
        assert got == brute(prints, radius), radius


def test_edges(spark):
    rows = [(5, None), (7, ""), (7, " \n"), (None, "a b c"), (3, "a b c"), (3, "A B C"), (9, "word " * 300_000), (1, "word")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, component_id string")
    got = simhash.digest(docs).collect()
    assert sorted(str((r.doc_id, r.component_id)) for r in got) == sorted(str(x) for x in [(5, 5), (7, 5), (7, 5), (None, 3), (3, 3), (3, 3), (9, 9), (1, 1)])
    assert {r.fingerprint for r in got if r.component_id == 5} == {"0" * 16}
    left = simhash.survivors(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 5, 9]
    assert simhash.digest(docs.limit(0)).count() == simhash.survivors(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{i: 100 for i in range(101, 140)}}
