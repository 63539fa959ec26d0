"""Centroid clustering whose bounds are loosened by geometry (Rysavy and Hamerly 2016), with exact whole-number results.

A vector keeps a lower bound on its distance to every centroid but its own. When centroids move, the bound falls by the
most that any point of the cluster's sphere can come nearer to a moved centroid, which planar geometry gives and which
is mostly far less than the way the centroid went. A vector whose own distance stays below its bound keeps its cluster;
the others are ambiguous and compared with all centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import written

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
SCALE = 64
SEED = 1
#: Largest number of a component: squared distances of 64 such components still fit a long.
LARGEST = 1 << 27
#: Relative room for rounding in bounds, which are floating point; distances that decide are whole numbers.
SLACK = 1e-9
#: Vectors compared with all centroids at a time.
BLOCK = 4096
STATE = "cluster int, distance bigint, bound double, scanned boolean"


def whole(vector: Column, dimensions: int = DIMENSIONS, scale: int = SCALE) -> Column:
    """The vector as whole numbers, or null if it has another length or a null or non-finite component."""
    wide = vector.cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = vector.isNotNull() & (F.size(vector) == dimensions) & ~F.exists(wide, bad)
    return F.when(ok, F.transform(wide, lambda x: F.floor(x * F.lit(float(scale)))))


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the distance to centroid j can shrink for a point of cluster i, for all i and j.

    The points of cluster i lie in a sphere round its old centroid. Where the distance to j shrinks by d, a point lies on
    a hyperbola whose foci are the old and the new place of j; outside the cone of its asymptotes, whose axis runs from
    the middle of the foci to the new place, the distance shrinks by less than drift times the cosine of the cone's angle.
    So the least angle of the sphere to that axis, in the plane of the three points, gives the bound; a sphere that holds
    the middle or the axis gets the full drift, and one behind the middle none.
    """
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    axis = np.divide(move, drift[:, None], out=np.zeros_like(move), where=drift[:, None] > 0)
    from_middle = old[:, None, :] - (old + new)[None, :, :] / 2  # of the sphere's centre, by cluster and moved centroid
    far = np.sqrt((from_middle**2).sum(2))
    along = (from_middle * axis[None, :, :]).sum(2)
    outside = far > radius[:, None] * (1 + SLACK)
    safe = np.where(far > 0, far, 1.0)
    angle = np.arccos(np.clip(along / safe, -1.0, 1.0)) - np.arcsin(np.clip(radius[:, None] / safe, 0.0, 1.0))
    share = np.where(outside, np.cos(np.clip(angle - 1e-7, 0.0, np.pi / 2)), 1.0)
    return share * drift[None, :]


def _squares(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to centroids."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1) if len(x) else np.zeros((0, len(centroids)), np.int64)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number on ties), its squared distance and the distance of the second nearest."""
    cluster, distance, bound = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    for at in range(0, len(x), BLOCK):
        d = _squares(x[at : at + BLOCK], centroids)
        best = d.argmin(1)
        rows = np.arange(len(d))
        cluster[at : at + BLOCK], distance[at : at + BLOCK] = best, d[rows, best]
        if len(centroids) > 1:
            bound[at : at + BLOCK] = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
    return cluster, distance, bound


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index("_x"))
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(len(lists), -1)
    if len(x) and np.abs(x).max() > LARGEST:
        raise ValueError("a component is so large that squared distances have no long; scale the vectors down")
    return x


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def assigned(rows: DataFrame, centroids: np.ndarray, fall: np.ndarray | None = None) -> DataFrame:
    """``rows`` with their nearest centroids. ``fall``: how much each old cluster's bound falls; without it all rows are scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch)
            if fall is None:
                todo = np.ones(len(x), bool)
                cluster, distance, bound = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
            elif len(x):
                cluster = _numbers(batch, "cluster").astype(np.int64)
                distance = ((x - centroids[cluster]) ** 2).sum(1)
                bound = _numbers(batch, "bound") * (1 - SLACK) - fall[cluster]
                todo = ~(np.sqrt(distance.astype(np.float64)) * (1 + SLACK) + SLACK < bound)
            else:
                continue
            if todo.any():
                cluster[todo], distance[todo], bound[todo] = scan(x[todo], centroids)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("_id", "_x")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(bound), pa.array(todo)], ["_id", "_x", "cluster", "distance", "bound", "scanned"])

    return rows.mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, _x array<bigint>, {STATE}")


def _first(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hashes of seed and id; of equal ids the smaller vector comes first."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    rows = vectors.where(F.col("_id").isNotNull()).select(h.alias("h"), "_x").orderBy("h", "_x").limit(clusters).collect()
    return np.array([r["_x"] for r in rows], np.int64)


def _summary(table: DataFrame, clusters: int, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, sums of their components and the largest squared distance by cluster: one row a cluster and task."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, total = np.zeros(clusters, np.int64), np.zeros(clusters, np.int64), np.zeros((clusters, dimensions), np.int64)
        for batch in batches:
            x, cluster, distance = _matrix(batch), _numbers(batch, "cluster"), _numbers(batch, "distance")
            np.add.at(n, cluster, 1)
            np.maximum.at(top, cluster, distance)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(top[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "top", "total"])

    parts = table.select("_x", "cluster", "distance").mapInArrow(sums, "cluster int, n bigint, top bigint, total array<bigint>")
    # decimals: sums of all partitions may be larger than a long
    each = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimensions)]
    n, top, total = np.zeros(clusters, object), np.zeros(clusters, np.int64), np.zeros((clusters, dimensions), object)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("top").alias("top"), *each).collect():  # a row a cluster
        n[r["cluster"]], top[r["cluster"]] = r["n"], r["top"]
        total[r["cluster"]] = [int(r[f"s{i}"]) for i in range(dimensions)]
    return n, top, total


def cluster(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED,
) -> tuple[DataFrame, np.ndarray]:
    """The vectors that take part, with ``_id``, ``_x`` (whole numbers), ``cluster``, ``distance`` (squared) and ``scanned`` (whether the
    last assignment had to compare it with all centroids), and the final centroids.

    Null vectors, those of another length and those with a null or non-finite component take no part. A null id takes part, but
    is no first centroid. Repeated rows count each. Of equal distances the centroid of the smaller number wins. With fewer
    vectors than ``clusters`` there are as many centroids as vectors with ids; with none the result is empty. Other columns take no part.
    """
    vectors = df.select(F.col(f"`{vec_id}`").alias("_id"), whole(F.col(f"`{vector}`"), dimensions, scale).alias("_x")).where("_x is not null")
    vectors = written(vectors, "vectors")
    centroids = _first(vectors, clusters, seed)
    if not len(centroids):
        empty = vectors.limit(0).selectExpr("*", "cast(null as int) as cluster", "cast(null as bigint) as distance", "cast(null as double) as bound", "true as scanned")
        return empty, centroids
    fall, table = None, vectors
    for turn in range(rounds + 1):
        table = written(assigned(table, centroids, fall), "assigned")
        if turn == rounds:
            return table, centroids
        n, top, total = _summary(table, len(centroids), dimensions)
        new = centroids.copy()
        for c in np.flatnonzero(n):
            new[c] = [s // int(n[c]) for s in total[c]]
        # how much nearer any other centroid can have come, for a vector of each cluster
        near = loosening(centroids.astype(np.float64), new.astype(np.float64), np.sqrt(top.astype(np.float64)))
        np.fill_diagonal(near, 0.0)
        fall, centroids = near.max(1) * (1 + SLACK), new
    raise ValueError("rounds must not be negative")


def digest(df: DataFrame) -> DataFrame:
    """A row for each vector that takes part."""
    table, centroids = cluster(df)
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = table.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    total = sum(r["cluster_inertia"] for r in sums)
    by = {r["cluster"]: r["cluster_inertia"] for r in sums}
    about = table.sparkSession.createDataFrame([(i, by.get(i, 0), total, h) for i, h in names], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = table.select(F.col("_id").alias("vec_id"), "cluster", "distance").join(F.broadcast(about), "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """For the check: every round compares all vectors with all centroids."""
    parts = [
        f"""v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
     WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1 AS k, x FROM v WHERE vec_id IS NOT NULL QUALIFY k < {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""d{i} AS (SELECT r, k, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS distance FROM v CROSS JOIN c{i} c)""")
        parts.append(f"a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)")
        if i < ROUNDS:
            parts.append(f"""m{i} AS (SELECT k, list(s ORDER BY j) AS x FROM (
     SELECT k, j, (sum(e) - (((sum(e) % count(*)) + count(*)) % count(*))) // count(*) AS s FROM (SELECT k, unnest(x) AS e, generate_subscripts(x, 1) AS j FROM a{i} JOIN v USING (r)) GROUP BY k, j) GROUP BY k)""")
            parts.append(f"c{i + 1} AS (SELECT c.k, coalesce(m.x, c.x)::BIGINT[] AS x FROM c{i} c LEFT JOIN m{i} m USING (k))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, k::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY k))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN c{ROUNDS} c USING (k)
"""


SQL = _sql()
