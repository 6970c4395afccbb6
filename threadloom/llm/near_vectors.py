"""Near-duplicate vectors by NN-descent.

Equal vectors of a label are one, with their number. Every vector has a list of its nearest so far, at first those that share a cell of one
of a few random hyperplane tables. Each round joins vectors through those between them: a vector, its neighbours and those that have it as
theirs are compared with each other, and all lists keep their best. Only vectors whose surroundings changed are in a round, and the first round that
brings no list a link is the last. Links are the entries of lists at the threshold.

A list full of links is saturated: its vector may have more. Its list is enlarged to its whole component, as the links make it, which is
compared in blocks that count the links of their rows and send counts, not pairs; so a dense group of any size is whole and no task holds
more than two blocks. The counts are audited against all rows of the label; where they fall short of what is wanted, lists are
doubled, and in the end a label is compared with itself, block by block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._graph import components
from ._shared import staged
from ._vectors import by_length, matrix, usable

#: Vectors of a cell on average, and of a block at most; hyperplane tables; neighbours in a list at first and at most; vectors that
#: recall is audited on.
CELL, BLOCK, TABLES, LIST, MOST, AUDITED = 64, 1024, 3, 8, 32, 64
MOST_BITS = 24
NEAR = "_id long, _near array<struct<_cos:double,_id:long>>"


def bits(count: int) -> int:
    """Bits of the codes of a label with count vectors."""
    return min(MOST_BITS, max(0, math.ceil(math.log2(max(1, count) / CELL))))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    planes: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        out, counts = [[]] * batch.num_rows, batch.column("_n").to_numpy()
        for same, v in by_length(batch.column("_v")):
            for n in np.unique(counts[same]):
                some, b = np.flatnonzero(counts[same] == n), bits(int(n))
                codes = np.zeros((len(some), TABLES if b else 1), dtype=np.int32)
                for t in range(TABLES if b else 0):
                    if (t, v.shape[1]) not in planes:
                        planes[t, v.shape[1]] = np.random.default_rng(1000 + t).standard_normal((MOST_BITS, v.shape[1]))
                    codes[:, t] = (v[some] @ planes[t, v.shape[1]][:b].T > 0) @ (1 << np.arange(b))
                for r, c in zip(same[some].tolist(), codes.tolist()):
                    out[r] = c
        yield pa.record_batch([batch.column("_id"), pa.array(out, pa.list_(pa.int32()))], ["_id", "_codes"])


def _nearest_in(keys: list[str], size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The best of its group for each vector of rows that are sorted by the groups' keys, of those nearer than the worst that its list
    has; a task holds one batch and one group."""

    def lists_of(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, worst, column = rows.column("_id").to_numpy(), rows.column("_worst").to_numpy(), rows.column("_v").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        values, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
        near, cosines, lengths = [], [], []
        for s, e in zip(starts, [*starts[1:], len(ids)]):
            v = values[at[s] : at[e]].reshape(e - s, -1)
            v = v / np.linalg.norm(v, axis=1)[:, None]
            cos = v @ v.T
            np.fill_diagonal(cos, -2.0)
            k = min(size, e - s - 1)
            order = np.argpartition(-cos, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((e - s, 0), np.int64)
            best = np.take_along_axis(cos, order, axis=1)
            better = best > worst[s:e, None]
            near.append(ids[s:e][order][better])
            cosines.append(best[better])
            lengths.append(better.sum(axis=1))
        entries = pa.StructArray.from_arrays([pa.array(np.concatenate(cosines)), pa.array(np.concatenate(near), pa.int64())], ["_cos", "_id"])
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
        return pa.record_batch([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), entries)], ["_id", "_near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _and_end(batches):
            if batch is not None:
                held.append(batch)
            rows = pa.Table.from_batches(held) if held else None
            if rows is None or not len(rows):
                continue
            new = np.zeros(len(rows), bool)
            new[0] = True
            for k in keys:
                c = rows.column(k).combine_chunks().dictionary_encode()
                c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
                new[1:] |= np.diff(c.indices.to_numpy()) != 0
            starts = np.flatnonzero(new)
            if batch is None:
                yield lists_of(rows, starts)
            elif len(starts) > 1:  # the last group may go on in the next batch
                yield lists_of(rows.slice(0, starts[-1]), starts[:-1])
                held = rows.slice(starts[-1]).to_batches()

    return run


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _best(lists: DataFrame, size: int) -> DataFrame:
    """One list of each vector from several; an entry that several have counts once."""
    every = F.reverse(F.array_sort(F.flatten(F.collect_list("_near"))))
    one = lambda near: F.filter(near, lambda x, i: (i == 0) | (F.get(near, i - 1)["_id"] != x["_id"]))
    grouped = lists.groupBy("_id").agg(every.alias("_near"))
    return grouped.select("_id", F.slice(one(F.col("_near")), 1, size).alias("_near"))


def _grouped(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    return rows.select(*keys, "_id", "_v", "_worst").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_nearest_in(keys, size), NEAR).where(F.size("_near") > 0)


def _first_lists(sized: DataFrame, size: int) -> DataFrame:
    """Lists from the cells of the tables; a cell of more than a block is dealt into several."""
    coded = staged(sized.select("_id", "_v", "_n").mapInArrow(_codes, "_id long, _codes array<int>"), "codes")
    cells = coded.join(sized.select("_id", "_label"), "_id").select("_id", "_label", F.posexplode("_codes").alias("_table", "_code"))
    keys = ["_label", "_table", "_code"]
    held = cells.groupBy(*keys).agg(F.count("*").alias("_in")).where("_in > 1")
    dealt = cells.join(held, keys).withColumn("_sub", F.pmod(F.xxhash64("_id"), F.ceil(F.col("_in") / BLOCK)))
    found = _grouped(dealt.join(sized.select("_id", "_v", F.lit(-2.0).alias("_worst")), "_id"), [*keys, "_sub"], size)
    return staged(_best(found, size), "lists")


def descend(sized: DataFrame, threshold: float, size: int) -> DataFrame:
    """_id, _near: the lists of neighbours after the last round."""
    vectors = sized.select("_id", "_v")
    linked = lambda df: df.agg(F.sum(F.size(F.filter("_near", lambda x: x["_cos"] >= threshold)))).first()[0]
    lists = changed = _first_lists(sized, size)
    before = linked(lists)
    while True:
        entries = lambda df: df.select("_id", F.explode("_near").alias("n")).select(F.col("_id").alias("_mid"), F.col("n._id").alias("_id"), F.col("n._cos").alias("_cos"))
        forward = entries(lists)
        rank = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("_cos"), "_mid"))
        back = forward.withColumn("_rank", rank).where(F.col("_rank") <= size).select(F.col("_id").alias("_mid"), F.col("_mid").alias("_id"))
        own = lists.select(F.col("_id").alias("_mid"), "_id")
        active = changed.select(F.col("_id").alias("_mid")).unionByName(entries(changed).select(F.col("_id").alias("_mid"))).distinct()
        around = forward.select("_mid", "_id").unionByName(back).unionByName(own).join(active, "_mid", "left_semi").distinct()
        worst = lists.select("_id", F.when(F.size("_near") == size, F.element_at("_near", -1)["_cos"]).otherwise(-2.0).alias("_worst"))
        met = _grouped(around.join(vectors.join(worst, "_id"), "_id"), ["_mid"], size)
        new = staged(_best(lists.unionByName(met), size), "lists")
        ids = lambda c: F.array_sort(F.transform(c, lambda x: x["_id"]))
        both = new.join(lists.select("_id", F.col("_near").alias("_old")), "_id", "left")
        changed = staged(both.where(F.col("_old").isNull() | (ids(F.col("_near")) != ids(F.col("_old")))).select("_id", "_near"), "changed")
        lists = new
        now = linked(lists)
        if now == before:
            return lists
        before = now


def smallest_linked(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id in each row's component of a symmetric matrix."""
    least = ids.copy()
    while True:
        new = np.minimum(least, np.where(linked, least[None], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
        if (new == least).all():
            return least
        least = new


def _block(threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key[1:])
        ids, sub, v = rows.column("_id").to_numpy(), rows.column("_sub").to_numpy(), matrix(rows.column("_v"))
        v /= np.linalg.norm(v, axis=1)[:, None]
        linked = v @ v.T >= threshold
        np.fill_diagonal(linked, False)
        if i != j:  # the blocks' own pairs are compared where i = j
            linked[np.equal.outer(sub, sub)] = False
        counts = linked @ rows.column("_w").to_numpy()
        keep = np.flatnonzero(counts)
        return pa.table([pa.array(ids[keep], pa.int64()), pa.array(counts[keep], pa.int64()), pa.array(smallest_linked(linked, ids)[keep], pa.int64())], ["_id", "_links", "_least"])

    return run


def _compared(members: DataFrame, threshold: float) -> DataFrame:
    """_id, _links, _least from all pairs within each group of members (_group, _id, _v, _w), block by block."""
    sizes = members.groupBy("_group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    dealt = members.join(sizes, "_group").withColumn("_sub", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int"))
    paired = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_i", F.least("_sub", "_other")).withColumn("_j", F.greatest("_sub", "_other"))
    return paired.select("_group", "_i", "_j", "_id", "_sub", "_v", "_w").groupBy("_group", "_i", "_j").applyInArrow(_block(threshold), "_id long, _links long, _least long")


def _audit(rows: DataFrame, found: DataFrame, threshold: float) -> float:
    """How well the counts of links agree, with those counted among all rows, of AUDITED vectors by hash of the
    id and of AUDITED that have links."""
    order = lambda df: df.orderBy(F.xxhash64("_id"), "_id").limit(AUDITED).select("_id")
    some = staged(order(rows).unionByName(order(found)).distinct(), "audited")  # at most 2 * AUDITED rows
    known = {r["_id"]: r["_links"] for r in some.join(found, "_id").collect()}
    queries = rows.join(F.broadcast(some), "_id").select("_id", "_label", "_v").toArrow()
    vectors = [np.asarray(v, np.float64) for v in queries.column("_v").to_pylist()]
    sent = rows.sparkSession.sparkContext.broadcast((queries.column("_id").to_numpy(), queries.column("_label").to_pylist(), vectors))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, label, vectors = sent.value
        for batch in batches:
            total, labels = np.zeros(len(own), np.int64), np.asarray(batch.column("_label").to_pylist(), object)
            for same, v in by_length(batch.column("_v")):
                v /= np.linalg.norm(v, axis=1)[:, None]
                weight, ids = batch.column("_w").to_numpy()[same], batch.column("_id").to_numpy()[same]
                for i, q in enumerate(vectors):
                    if len(q) == v.shape[1]:
                        hit = (v @ (q / np.linalg.norm(q)) >= threshold) & (labels[same] == label[i])
                        total[i] += (weight - (ids == own[i])) @ hit
            yield pa.record_batch([pa.array(own, pa.int64()), pa.array(total, pa.int64())], ["_id", "n"])

    truth = {r["_id"]: r["n"] for r in rows.mapInArrow(count, "_id long, n long").groupBy("_id").agg(F.sum("n").alias("n")).collect()}
    return 1 - sum(abs(known.get(i, 0) - n) for i, n in truth.items()) / max(1, sum(truth.values()))


def link_vectors(vectors: DataFrame, *, threshold: float = 0.93, wanted: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row for each id: id_col, n_links, component_id (smallest id reachable by links),
    kept (id_col = component_id), of links between vectors of one label, which isn't null,
    with cosine >= threshold.

    Vectors that are null, zero or with null or non-finite components link with nothing and are kept, as
    are those with a null label; vectors of different lengths don't link with each other. A
    null id is a row of its own without links, with a null component. An id that repeats is
    one vector: its first usable one. An empty table gives no rows; other columns are ignored.
    """
    ok = usable(vectors.select(F.col(id_col).alias("_i"), F.col(vector_col).alias("_vec"), F.col(label_col).cast("string").alias("_label")), "_i", "_vec", "_label").where("_label is not null")
    ids = vectors.select(F.col(id_col).cast("long").alias(id_col))
    ok = ok.withColumn("_label", F.concat(F.size("_v").cast("string"), F.lit(":"), "_label"))
    once = staged(ok.groupBy("_id").agg(F.min(F.struct("_label", "_v")).alias("_x")).select("_id", "_x._label", "_x._v"), "ids")
    same = once.groupBy("_label", "_v").agg(F.min("_id").alias("_to"), F.count("*").alias("_w"))
    same = staged(same, "equal-vectors")
    copies = staged(once.join(same.where("_w > 1"), ["_label", "_v"]).where("_id <> _to").select("_id", "_to"), "copies")
    once = same.select(F.col("_to").alias("_id"), "_label", "_v", "_w")
    sized = once.join(once.groupBy("_label").agg(F.count("*").alias("_n")), "_label")
    size = LIST
    while True:
        links, edges = _links(sized, threshold, size)
        if size > MOST or _audit(once, links, threshold) >= wanted:
            break
        size *= 2
    links = links.unionByName(copies.join(links.withColumnRenamed("_id", "_to"), "_to").select("_id", "_links"))
    least = components(edges.unionByName(copies.select(F.col("_id").alias("a"), F.col("_to").alias("b"))))
    each = ids.where(F.col(id_col).isNotNull()).distinct().unionByName(ids.where(F.col(id_col).isNull()))
    out = each.join(links.withColumnRenamed("_id", id_col), id_col, "left").join(least.withColumnRenamed("id", id_col), id_col, "left")
    return out.select(id_col, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", id_col).alias("component_id"), F.coalesce(F.coalesce("component_id", id_col) == F.col(id_col), F.lit(True)).alias("kept"))


def _links(sized: DataFrame, threshold: float, size: int) -> tuple[DataFrame, DataFrame]:
    """_id and _links of vectors with links; edges (a, b) that connect what the links connect. Lists of more than MOST
    stand for comparing each label with itself."""
    rows = sized.select("_id", "_label", "_v", "_w")
    if size > MOST:
        dense = staged(_compared(rows.withColumn("_group", F.xxhash64("_label")), threshold), "block-links")
        pairs = None
    else:
        lists = descend(sized, threshold, size)
        near = lists.select(F.col("_id").alias("a"), F.explode(F.filter("_near", lambda x: x["_cos"] >= threshold)).alias("n")).select("a", F.col("n._id").alias("b"))
        near = staged(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "list-links")
        parts = components(near)
        full = lists.where((F.size("_near") == size) & (F.element_at("_near", -1)["_cos"] >= threshold)).select(F.col("_id").alias("id"))
        crowded = parts.join(parts.join(full, "id").select("component_id").distinct(), "component_id", "left_semi").select(F.col("id").alias("_id"), F.col("component_id").alias("_group"))
        crowded = staged(crowded, "crowded")
        dense = staged(_compared(crowded.join(rows, "_id"), threshold), "block-links")
        pairs = near.join(crowded.select(F.col("_id").alias("a")), "a", "left_anti")
    own = rows.where("_w > 1").select("_id", (F.col("_w") - 1).alias("_links"))
    links, edges = dense.select("_id", "_links").unionByName(own), dense.where("_id <> _least").select(F.col("_id").alias("a"), F.col("_least").alias("b"))
    if pairs is not None:
        weighed = pairs.join(rows.select(F.col("_id").alias("b"), F.col("_w").alias("_links")), "b")
        links, edges = links.unionByName(weighed.select(F.col("a").alias("_id"), "_links")), edges.unionByName(pairs)
    return staged(links.groupBy("_id").agg(F.sum("_links").alias("_links")).where("_links > 0"), "links"), staged(edges.distinct(), "edges")
