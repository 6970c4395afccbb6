"""Clusters against plain integer arithmetic, with awkward rows, ties and groups that lie apart."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from threadloom.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string, q int, z string, n long"


def vectors(n: int = 400, d: int = 64) -> list[tuple]:
    rng = np.random.default_rng(3)
    apart = rng.standard_normal((6, d)) * 3
    rows = [(i, [float(x) for x in apart[i % 6] + 0.1 * rng.standard_normal(d)]) for i in range(n)]
    rows += [(900 + i, [float(x) for x in rng.integers(-1, 2, d)]) for i in range(60)]  # many ties
    rows += [rows[0], rows[1], (5, rows[7][1]), (None, rows[3][1]), (-7, [0.0] * d), (2000, [-1 / 128] * d)]
    odd = [(3000, None), (3001, []), (3002, [1.0] * (d - 1)), (3003, [1.0] * (d + 1)), (3004, [None, *[1.0] * (d - 1)]), (3005, [math.nan] * d), (3006, [1.0] * (d - 1) + [math.inf]), (3007, [float(1 << 21)] * d)]
    return [(*r, "own", 1, "z", 2) for r in rows + odd]


def expected(rows: list[tuple], k: int, rounds: int) -> list[tuple]:
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 1 << 21 for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [q for _, q in sorted(kept, key=key)[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        of = [nearest(q)[1] for _, q in kept]
        members = [[q for (_, q), o in zip(kept, of) if o == j] for j in range(len(cents))]
        cents = [[sum(col) // len(m) for col in zip(*m)] if m else c for m, c in zip(members, cents)]
    final = [(i, *nearest(q)) for i, q in kept]
    return [(i, j, d, sum(x[1] for x in final if x[2] == j), sum(x[1] for x in final), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in final]


def same(df, want):
    assert sorted(map(repr, map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()))) == sorted(map(repr, want))


def test_clusters(spark, monkeypatch):
    monkeypatch.setattr(centroids, "ROWS", 50)
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for width in (4, 5):  # a segment that isn't full
        monkeypatch.setattr(centroids, "WIDTH", width)
        same(centroids.clusters_with_inertia(df), expected(rows, 16, 3))
    assert centroids.clusters_with_inertia(df.limit(0)).count() == 0
    assert centroids.clusters_with_inertia(df.where("vec_id >= 3000")).count() == 0


def test_few_vectors(spark):
    for rows in (vectors()[:5], [r for r in vectors() if r[0] is None or r[0] in (5, -7)], [(None, [1.0] * 64, "", 1, "", 1)] * 3):
        same(centroids.clusters_with_inertia(spark.createDataFrame(rows, SCHEMA)), expected(rows, 16, 3))


def test_screening_spares_comparisons(spark):
    rows = [r for r in vectors() if r[0] is not None and r[0] < 400]
    out, final = centroids.cluster(spark.createDataFrame(rows, SCHEMA), k=6, rounds=3)
    assert final.shape == (6, 64)
    assert out.agg(F.avg("compared")).first()[0] < 3
