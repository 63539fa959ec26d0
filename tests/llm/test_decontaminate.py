import hashlib
import random
import re

import pytest

from tests.oracle import connect, rows_of
from tidemark.llm import decontaminate
from tidemark.llm.queries import LLM_ORACLES, LLM_QUERIES


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in range(len(w)):
            for n in {len(x) for x in windows}:
                if owners := windows.get(tuple(w[k : k + n]) if k + n <= len(w) else None):
                    hit |= set(range(k, k + n))
                    ids |= owners
        sha = hashlib.sha256(",".join(sorted(str(i) for i in ids if i is not None)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids - {None}), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_sql(spark, sf_dir):
    df = LLM_QUERIES["op1_decontamination"](spark, sf_dir)
    cur = connect(sf_dir).execute(LLM_ORACLES["op1_decontamination"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("index_words", [decontaminate.INDEX_WORDS, 60])
def test_small_vocabulary_in_one_index_and_in_blocks(spark, index_words):
    rnd = random.Random(5)
    text = lambda n: " ".join(rnd.choices("a b c é A, d.".split(), k=n))
    items = [(i, text(n)) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 30, 30])] + [(99, ""), (98, None), (None, "a b c d"), (4, text(20)), (100, "zz zz")]
    docs = [(i, text(rnd.randint(0, 60))) for i in range(60)] + [(1, None), (2, ""), (None, items[7][1]), (7, items[6][1] + " q " + items[8][1].upper()), (7, "zz zz zz")] * 2
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, _hits int").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    out, h = decontaminate.contamination(d, b, index_words=index_words)
    assert h != "_hits" and set(d.columns) < set(out.columns)
    rows = out.select("doc_id", f"{h}.n_words", decontaminate.n_hit(h), f"{h}.items", decontaminate.contaminated(h)).collect()
    got = sorted(((r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[4]) for r in rows), key=str)
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate.digest(docs.limit(0), items).count() == 0
    assert [tuple(r)[1:4] for r in decontaminate.digest(docs, items.limit(0)).collect()] == [(2, 0, 0)]
    assert [tuple(r)[1:4] for r in decontaminate.digest(docs, items).collect()] == [(2, 2, 1)]
