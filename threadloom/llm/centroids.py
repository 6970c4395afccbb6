"""Centroid clustering of integer vectors, exact, with candidates screened by the norms of blocks.

Vectors become integers once and are stored with a compressed form: of each segment of components the sum, and
the norm of what remains without the mean. By Cauchy-Schwarz, the squared distance to a centroid is at least the
sum over segments of (difference of sums)^2 / width + (difference of norms)^2. The centroid with the smallest bound is
compared exactly, and then those whose bounds don't exceed that distance; so every result is what comparing all gives.

Each round is one pass without a shuffle of vectors: tasks add up their own clusters, and only these sums
are shuffled. The driver holds k centroids and nothing that grows with the rows.

Kept are vectors of the given number of components, none null or not finite, and none beyond 2^21 in
magnitude, as squared distances wouldn't be longs. Fewer vectors than k make fewer centroids; an empty table
gives no rows. Rows with a null id are the last to begin a cluster; repeated rows count each, and may begin a
cluster each. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged
from ._vectors import matrix

#: Components of a segment.
WIDTH = 4
#: Vectors compared at once: 16 x 64 x 4,096 integers are 32 MB.
ROWS = 4096
SCALE, LARGEST = 64, float(1 << 21)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """id, q: floor(64 x) of each component of the vectors that are kept."""
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < LARGEST))  # false for NaN, which is above all numbers
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == dimensions) & fine).select("id", F.transform("v", lambda x: F.floor(x * SCALE).cast("int")).alias("q"))


def _compressed(q: np.ndarray) -> np.ndarray:
    """The sums of segments over the root of their width, and the norms of what remains."""
    n, d = q.shape
    parts = np.pad(q, ((0, 0), (0, -d % WIDTH))).reshape(n, -1, WIDTH).astype(np.float64)
    sums = parts.sum(axis=2)
    rest = parts - sums[:, :, None] / WIDTH
    return np.concatenate([sums / np.sqrt(WIDTH), np.sqrt((rest * rest).sum(axis=2))], axis=1)


def with_norms(vectors: DataFrame) -> DataFrame:
    """id, q, z: vectors with their compressed form, staged; it is computed once for all rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            z = _compressed(matrix(b.column("q")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("q"), flat], ["id", "q", "z"])

    return staged(vectors.mapInArrow(run, "id long, q array<int>, z array<double>"), "centroid-vectors")


def _assigned(q: np.ndarray, z: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance, number of centroids that were compared) of each vector."""
    c = _compressed(centroids)
    size = (z * z).sum(axis=1)[:, None] + (c * c).sum(axis=1)
    bound = (size - 2 * (z @ c.T)) - 1e-9 * size - 1e-9  # below the true bound, whatever the rounding
    rows = np.arange(len(q))
    first = bound.argmin(axis=1)
    exact = np.full(bound.shape, np.iinfo(np.int64).max)

    def compare(r: np.ndarray, k: np.ndarray) -> None:
        gap = q[r] - centroids[k]
        exact[r, k] = np.einsum("ij,ij->i", gap, gap)

    compare(rows, first)
    left = bound <= exact[rows, first][:, None]
    left[rows, first] = False
    compare(*np.nonzero(left))
    best = exact.argmin(axis=1)  # the first of equal ones
    return best, exact[rows, best], left.sum(axis=1) + 1


def _chunks(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, len(b), ROWS):
            part = b.slice(at, ROWS)
            q, z = matrix(part.column("q")).astype(np.int64), matrix(part.column("z"))
            yield part, q, *_assigned(q, z, centroids)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """(count, sums of components) of each cluster that has vectors: added up within tasks, then between them."""
    k, d = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        for _, q, best, _, _ in _chunks(batches, centroids):
            total += np.rint((best == np.arange(k)[:, None]).astype(np.float64) @ q).astype(np.int64)  # sums below 2^53
            count += np.bincount(best, minlength=k)
        has = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(has.astype(np.int32)), "n": pa.array(count[has]), "s": pa.array([list(map(int, r)) for r in total[has]], pa.list_(pa.int64()))})

    parts = vectors.mapInArrow(run, "cluster int, n long, s array<long>")
    by_component = parts.select("cluster", "n", F.posexplode("s")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in by_component.orderBy("cluster", "pos").collect():  # k x dimensions rows
        out.setdefault(r["cluster"], (r["n"], []))[1].append(r["s"])
    return out


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, dimensions: int = 64, k: int = 16, rounds: int = 3, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, compared of every kept vector; the final centroids). The first centroids are the k
    vectors with the smallest SHA-256 of seed and id; compared is how many centroids were not screened out."""
    vectors = with_norms(integer_vectors(df, id_col, vector_col, dimensions))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.select(key.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    centroids = np.array([r["q"] for r in first], np.int64).reshape(len(first), dimensions)
    schema = "id long, cluster int, distance long, compared int"
    if not len(first):
        return df.sparkSession.createDataFrame([], schema), centroids
    for _ in range(rounds):
        for c, (n, s) in _sums(vectors, centroids).items():
            centroids[c] = [x // n for x in s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, best, distance, compared in _chunks(batches, centroids):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(best.astype(np.int32)), pa.array(distance), pa.array(compared.astype(np.int32))], ["id", "cluster", "distance", "compared"])

    return staged(vectors.mapInArrow(run, schema), "centroid-clusters"), centroids


def clusters_with_inertia(df: DataFrame, **parameters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    rows, centroids = cluster(df, **parameters)
    digest = F.sha2(F.concat_ws(",", "c"), 256)
    names = df.sparkSession.createDataFrame([(i, list(map(int, c))) for i, c in enumerate(centroids)], "cluster int, c array<long>").select("cluster", digest.alias("centroid_sha256"))
    by_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(names, "cluster")
    total = rows.agg(F.sum("distance").alias("inertia"))  # one row
    small = by_cluster.crossJoin(F.broadcast(total))
    return rows.join(F.broadcast(small), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
