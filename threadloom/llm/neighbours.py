"""Approximate nearest neighbours from balanced posting lists.

A bounded sample is split at medians into lists of equal size; their centroids are held in
memory with a graph over them. Every vector is in the list of its nearest centroid and, where
it lies near a boundary, in others too. A query searches the graph for all centroids that are
at most a ratio further than its nearest one, and only those lists. The ratio is measured: the
smallest that finds the wanted share of the true neighbours of some queries among all rows.
A query whose lists hold too few vectors takes further ones, nearest first; those that still have
fewer neighbours than there are candidates are compared with all rows.

Largest inner products are nearest vectors once each vector gets a further component that
makes all of equal length (and queries a zero there).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged
from ._vectors import lists, matrix, usable

#: Bounds: vectors the lists are fitted on, lists, vectors a list should have, and a shard
#: (lists searched together) and a block of queries at most; queries the ratio is measured on.
SAMPLE, LISTS, LIST_ROWS, SHARD_ROWS, QUERY_ROWS, MEASURED = 20_000, 1024, 256, 8192, 1024, 128
#: A vector is also in lists whose centroid is so many times as far as its nearest; edges of a centroid.
BOUNDARY, DEGREE = 1.03, 12
#: Share of the measured queries' true neighbours that the results must have; else the ratio grows.
LEAST_RECALL = 0.93


def augmented(v: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([v, np.sqrt(np.maximum(0.0, longest * longest - np.einsum("ij,ij->i", v, v)))])


def balanced_centroids(v: np.ndarray, parts: int) -> np.ndarray:
    """Means of parts of equal size: each is halved at the median along its widest direction."""
    todo, out = [(np.arange(len(v)), parts)], []
    while todo:
        rows, k = todo.pop()
        if k <= 1 or len(rows) < 2:
            out.append(v[rows].mean(axis=0))
            continue
        centred = v[rows] - v[rows].mean(axis=0)
        direction = np.random.default_rng(len(rows)).standard_normal(v.shape[1])
        for _ in range(8):  # power iteration
            direction = centred.T @ (centred @ direction)
            direction /= np.linalg.norm(direction) or 1.0
        order = np.argsort(centred @ direction, kind="stable")
        half = len(rows) * (k // 2) // k
        todo += [(rows[order[half:]], k - k // 2), (rows[order[:half]], k // 2)]
    return np.asarray(out)


class Centroids:
    """Centroids with a graph of their nearest ones and a ring that keeps it connected."""

    def __init__(self, centroids: np.ndarray, longest: float):
        self.c, self.longest = centroids, longest
        self.norms = np.einsum("ij,ij->i", centroids, centroids)
        near = np.argsort(self.distances(centroids), axis=1)[:, 1 : DEGREE + 1]
        n = len(centroids)
        edges = [set(row.tolist()) | {(i + 1) % n, (i - 1) % n} for i, row in enumerate(near)]
        for i, row in enumerate(near):
            for j in row:
                edges[j].add(i)
        self.edges = [np.asarray(sorted(e - {i}), dtype=np.int64) for i, e in enumerate(edges)]
        self.between = np.sqrt(self.distances(centroids))

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Squared, of rows of v (augmented) to all centroids."""
        return np.maximum(0.0, self.norms[None] - 2 * (v @ self.c.T) + np.einsum("ij,ij->i", v, v)[:, None])

    def search(self, q: np.ndarray, ratio: float, counts: np.ndarray, least: int) -> list[int]:
        """Centroids within ratio times the distance of the nearest, and as many more as it takes for
        their lists (of counts rows) to hold least rows, nearest first, by best-first search: a
        node is left unexpanded only beyond that and after the nearest DEGREE."""
        far = lambda nodes: np.sqrt(np.maximum(0.0, ((self.c[nodes] - q) ** 2).sum(axis=1)))
        start = np.unique(np.linspace(0, len(self.c) - 1, min(16, len(self.c))).astype(np.int64))
        seen, heap, found = set(start.tolist()), list(zip(far(start).tolist(), start.tolist())), []
        heapq.heapify(heap)
        best, held = heap[0][0], 0
        while heap:
            d, i = heapq.heappop(heap)
            best = min(best, d)
            if d > ratio * best and len(found) >= DEGREE and held >= least:
                break
            found.append((d, i))
            held += counts[i]
            new = [j for j in self.edges[i].tolist() if j not in seen]
            if new:
                seen.update(new)
                for pair in zip(far(np.asarray(new)).tolist(), new):
                    heapq.heappush(heap, pair)
        out, held = [], 0
        for d, i in sorted(found):
            if d > ratio * best and held >= least:
                break
            out.append(i)
            held += counts[i]
        return out

    def assign(self, v: np.ndarray) -> list[list[int]]:
        """Lists of each vector: of its nearest centroid, and of others within BOUNDARY that no
        chosen centroid is nearer to than the vector."""
        d = np.sqrt(self.distances(augmented(v, self.longest)))
        out = []
        for row in d:
            order = np.flatnonzero(row <= BOUNDARY * row.min())
            chosen: list[int] = []
            for j in order[np.argsort(row[order], kind="stable")].tolist():
                if not chosen or self.between[j, chosen].min() >= row[j]:
                    chosen.append(j)
            out.append(chosen)
        return out


def fit(rows: DataFrame, count: int, longest: float) -> Centroids:
    parts = max(1, min(LISTS, count // LIST_ROWS))
    sample = rows.select("_v").orderBy(F.xxhash64("_id"), "_id").limit(min(SAMPLE, 32 * parts)).toArrow()
    return Centroids(balanced_centroids(augmented(matrix(sample.column("_v")), longest), parts), longest)


def _assign(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.record_batch([part.column("_id"), part.column("_v"), pa.array(sent.value.assign(matrix(part.column("_v"))), pa.list_(pa.int32()))], ["_id", "_v", "_lists"])

    return run


def _route(sent, ratio: float, counts: np.ndarray, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("_v"))
            found = [sent.value.search(np.append(q, 0.0), ratio, counts, least) for q in v]
            yield pa.record_batch([batch.column("_id"), batch.column("_v"), pa.array(found, pa.list_(pa.int32()))], ["_id", "_v", "_lists"])

    return run


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of a vector with rows, each summed in the same order, so equal rows tie."""
    return (v * q).sum(axis=1)


def top(q: np.ndarray, own: int, ids: np.ndarray, v: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of the candidates with rough scores near; ties to smaller ids."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        kth = np.partition(near[keep], -k)[-k]
        keep = keep[near[keep] >= kth - 1e-9 * max(1.0, abs(kth))]
    score = exact_scores(q, v[keep])
    order = np.lexsort((ids[keep], -score))
    _, first = np.unique(ids[keep][order], return_index=True)
    order = order[np.sort(first)][:k]
    return ids[keep][order], score[order]


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if rows.num_rows and queries.num_rows:
            ids, v, q, own = rows.column("_id").to_numpy(), matrix(rows.column("_v")), matrix(queries.column("_v")), queries.column("_id").to_numpy()
            (vr, vl), (qr, ql) = lists(rows.column("_lists")), lists(queries.column("_lists"))
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for l in np.intersect1d(vl, ql):
                r, s = vr[vl == l], qr[ql == l]
                near = q[s] @ v[r].T
                for i, row in zip(s.tolist(), near):
                    found.setdefault(i, []).append((r, row))
            for i, parts in found.items():
                r, near = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                got, score = top(q[i], own[i], ids[r], v[r], near, k)
                out.append((np.full(len(got), own[i]), got, score))
        cols = [np.concatenate([o[j] for o in out]) for j in range(3)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def brute_force(rows: DataFrame, queries: pa.Table, k: int, carry: str | None = None) -> DataFrame:
    """The k nearest among all rows for a bounded table of queries (_id, _v), block by block."""
    sent = rows.sparkSession.sparkContext.broadcast((queries.column("_id").to_numpy(), matrix(queries.column("_v"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = sent.value
        for batch in batches:
            ids, v = batch.column("_id").to_numpy(), matrix(batch.column("_v"))
            if not len(ids):
                continue
            near = q @ v.T
            place = {int(x): n for n, x in enumerate(ids)}
            for i in range(len(own)):
                got, score = top(q[i], own[i], ids, v, near[i], k)
                more = [batch.column(carry).take(pa.array([place[int(x)] for x in got], pa.int64()))] if carry else []
                yield pa.record_batch([pa.array(np.full(len(got), own[i]), pa.int64()), pa.array(got, pa.int64()), pa.array(score, pa.float64()), *more], ["query_id", "vec_id", "score", *([carry] if carry else [])])

    best = rows.mapInArrow(run, "query_id long, vec_id long, score double" + (f", {carry} array<int>" if carry else ""))
    return ranked(best, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def measured_ratio(postings: DataFrame, centroids: Centroids, queries: DataFrame, k: int, wanted: float) -> tuple[float, list[tuple[int, int]]]:
    """The smallest ratio at which the lists hold the wanted share of the true neighbours of at
    most MEASURED queries, found among all rows, and those neighbours: (query, id)."""
    some = queries.orderBy(F.xxhash64("_id"), "_id").limit(MEASURED).select("_id", "_v").toArrow()
    truth = brute_force(postings, some, k, "_lists").select("query_id", "vec_id", "_lists").collect()  # at most MEASURED * k rows
    d = dict(zip(some.column("_id").to_pylist(), np.sqrt(centroids.distances(np.column_stack([matrix(some.column("_v")), np.zeros(some.num_rows)])))))
    need = sorted(d[t["query_id"]][t["_lists"]].min() / max(1e-12, d[t["query_id"]].min()) for t in truth)
    ratio = float(need[min(len(need) - 1, math.ceil(wanted * len(need)))]) * (1 + 1e-9) if need else 1.0
    return ratio, [(t["query_id"], t["vec_id"]) for t in truth]


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], *, k: int = 20, wanted: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of largest inner product that the lists
    of each query hold, ties to smaller ids; fewer only if there are fewer candidates.

    Every row with an id and a vector that is finite and not zero takes part, queries too; others
    don't appear. Vectors of different lengths have no inner product: each length is searched by itself.
    A query's own id is no candidate, and an id that repeats counts once. An empty table gives no
    rows. Other columns are ignored.
    """
    rows = usable(vectors, id_col, vector_col)
    lengths = sorted(r["n"] for r in rows.select(F.size("_v").alias("n")).distinct().collect())  # a few, as vectors of one model have one
    found = [_nearest(rows.where(F.size("_v") == n), is_query, k, wanted) for n in lengths]
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found) if found else empty


def _nearest(rows: DataFrame, is_query: Callable[[Column], Column], k: int, wanted: float) -> DataFrame:
    spark = rows.sparkSession
    shape = rows.agg(F.count("*").alias("n"), F.max(F.aggregate(F.transform("_v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)).alias("m"), F.count(F.when(is_query(F.col("_id")), 1)).alias("q")).first()
    if not shape["n"] or not shape["q"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    centroids = fit(rows, shape["n"], math.sqrt(shape["m"]))
    sent = spark.sparkContext.broadcast(centroids)
    kind = rows.schema["_v"].dataType.simpleString()
    postings = staged(rows.mapInArrow(_assign(sent), f"_id long, _v {kind}, _lists array<int>"), "postings")
    queries = rows.where(is_query(F.col("_id")))
    ratio, truth = measured_ratio(postings, centroids, queries, k, wanted)
    counts = {r["l"]: r["n"] for r in postings.select(F.explode("_lists").alias("l")).groupBy("l").agg(F.count("*").alias("n")).collect()}  # at most LISTS rows
    sizes = np.asarray([counts.get(l, 0) for l in range(len(centroids.c))], np.int64)

    # Shards of neighbouring lists; a list with more rows than a shard has several, by hash of the id.
    shard_of, held, shard = {}, 0, 0
    for l in range(len(centroids.c)):
        n = counts.get(l, 0)
        if n > SHARD_ROWS:
            shard, parts = shard + bool(held), math.ceil(n / SHARD_ROWS)
            shard_of[l], shard, held = (shard, parts), shard + parts, 0
            continue
        if held and held + n > SHARD_ROWS:
            shard, held = shard + 1, 0
        shard_of[l], held = (shard, 1), held + n
    first = F.create_map(*[F.lit(x) for l, (s, _) in shard_of.items() for x in (l, s)])
    split = F.create_map(*[F.lit(x) for l, (_, p) in shard_of.items() for x in (l, p)])
    salt = lambda c: F.pmod(F.xxhash64(c, F.lit(7)), F.lit(1 << 30))
    held_in = F.array_distinct(F.transform("_lists", lambda l: (first[l] + (salt(F.col("_id")) % split[l])).cast("int")))
    asked_in = F.array_distinct(F.flatten(F.transform("_lists", lambda l: F.sequence(first[l], first[l] + split[l] - 1))))
    known = F.broadcast(spark.createDataFrame(truth, "query_id long, vec_id long"))  # at most MEASURED * k rows
    while True:
        routed = staged(queries.mapInArrow(_route(sent, ratio, sizes, k + 1), f"_id long, _v {kind}, _lists array<int>").withColumn("_shard", F.explode(asked_in)), "routed")
        # A shard's postings go once for each QUERY_ROWS queries that ask it.
        blocks = routed.groupBy("_shard").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("_blocks"))
        left = postings.withColumn("_shard", F.explode(held_in)).join(blocks, "_shard").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        right = routed.join(blocks, "_shard").withColumn("_block", (salt(F.col("_id")) % F.col("_blocks")).cast("int"))
        found = left.drop("_blocks").groupBy("_shard", "_block").cogroup(right.drop("_blocks").groupBy("_shard", "_block")).applyInArrow(_search(k), "query_id long, vec_id long, score double")
        found = staged(ranked(found, k).select("query_id", "rank", "vec_id", "score"), "found")
        if found.join(known, ["query_id", "vec_id"], "left_semi").count() >= LEAST_RECALL * len(truth) or ratio > 4:
            break
        ratio *= 1.1  # the graph's search missed more than the lists do
    return _completed(found, rows, queries, k)


def _completed(found: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """found, with the neighbours among all rows of queries that have fewer than k there, if there are
    more candidates: lists may overlap, and hold an id several times."""
    have = found.groupBy(F.col("query_id").alias("_id")).agg(F.count("*").alias("_n"))
    short = staged(queries.join(have, "_id", "left").where(F.coalesce("_n", F.lit(0)) < k).select("_id", "_v", F.coalesce("_n", F.lit(0)).alias("_n")), "short")
    if short.isEmpty():
        return found
    wanted = min(k, rows.select("_id").distinct().count() - 1)
    short = short.where(F.col("_n") < wanted)
    parts = math.ceil(short.count() / QUERY_ROWS)
    out = found
    for part in range(parts):
        some = short.where(F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(parts)) == part).select("_id", "_v").toArrow()
        if some.num_rows:
            out = out.unionByName(staged(brute_force(rows, some, k).select("query_id", "rank", "vec_id", "score"), "completed"))
    return ranked(out.drop("rank"), k).select("query_id", "rank", "vec_id", "score") if parts else found
