import hashlib
import math

import numpy as np

from tidemark.llm import centroids
from tidemark.llm.queries import table

KIND = "vec_id bigint, embedding array<double>, cluster string, distance int"


def plain(rows, k=16, rounds=3, dimensions=64):
    """Lloyd's rounds in loops over Python integers."""
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    for turn in range(rounds + 1):
        found = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            found.append((d.index(min(d)), min(d)))
        if turn < rounds:
            for c in range(len(centres)):
                mine = [v for (_, v), (at, _) in zip(kept, found, strict=True) if at == c]
                if mine:
                    centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    inertia = [sum(d for at, d in found if at == c) for c in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, at, d, inertia[at], sum(inertia), names[at]) for (i, _), (at, d) in zip(kept, found, strict=True)), key=str)


def got(df):
    return sorted(map(tuple, centroids.digest(df).collect()), key=str)


def test_all_vectors(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    assert got(df) == plain([(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=64).tolist()
    rows = [(i, rng.normal(size=64).tolist()) for i in range(40)] + [(100, base)] * 30 + [(None, base), (7, base)]
    rows += [(200, None), (201, base[:63]), (202, [*base[:63], None]), (203, [*base[:63], math.nan]), (204, [*base[:63], math.inf]), (205, [])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND).repartition(5)
    assert got(frame) == plain(rows)
    few = rows[:3]
    assert got(spark.createDataFrame([(*r, "x", 1) for r in few], KIND)) == plain(few)
    assert got(frame.limit(0)) == []
    assert got(spark.createDataFrame([(None, base, "x", 1)], KIND)) == []


def test_loosening_is_a_bound_and_less_than_drift():
    rng = np.random.default_rng(1)
    less = 0
    for _ in range(300):
        n = int(rng.integers(2, 8))
        old, radius = rng.normal(size=(4, n)) * 3, rng.uniform(0, 3, 4)
        new = old + rng.normal(size=(4, n)) * rng.uniform(0, 2)
        falls, drift = centroids.loosening(old, new, radius), np.sqrt(((new - old) ** 2).sum(1))
        way = rng.normal(size=(200, n))
        way /= np.sqrt((way**2).sum(1))[:, None]
        for i in range(4):
            x = old[i] + way * radius[i] * rng.uniform(0.8, 1, (200, 1))
            for j in range(4):
                fell = np.sqrt(((x - old[j]) ** 2).sum(1)) - np.sqrt(((x - new[j]) ** 2).sum(1))
                assert fell.max() <= falls[i, j] + 1e-9
                assert falls[i, j] <= drift[j] + 1e-9
                less += falls[i, j] < 0.5 * drift[j]
    assert less > 1000


def test_bounds_spare_scans(spark):
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(16, 64)) * 5
    rows = [(i, (middles[i % 16] + rng.normal(size=64) * 0.1).tolist()) for i in range(800)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)
    out, _ = centroids.cluster(frame)
    assert out.where("scanned").count() < 400
    assert got(frame) == plain(rows)
