"""Near-duplicate texts by Order MinHash.

A text's k-mers are its runs of five words, labelled with their occurrence, so that the set is
a multiset. Each of BANDS hash functions picks the LENGTH smallest and keeps them in the order
of the text; their hash is a key. Texts alike in their k-mers' set and order share some key:
at a Jaccard similarity of 0.8, all keys differ with a chance of about 3e-8.

Texts are numbered in the order of their ids. Those that share a key are compared with the first
there, and linked if at least 0.8 of their k-mers are common and an alignment within a band finds
an edit similarity of 0.8 or more. That makes most of a key's texts one group. What is left are
keys of several groups, and pairs of texts of different groups that share one: those are all
compared, so no link is lost, but for pairs that can't be alike, as their numbers of k-mers differ
too much or one has too few k-mers that any text of another group has. Keys of few texts give
their pairs; those with many are put together where texts share them, and compared block by
block: common k-mers of all pairs of two blocks are one product of matrices, and a block gives no more
links than it takes to join its groups. Equal texts are one text from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._anchors import DOC, mixed, with_texts
from ._graph import components
from ._shared import WORD, ordered_key, staged
from .substrings import FIND, symbols

#: Words of a k-mer, hash functions, k-mers of a key, and the similarity from which texts are linked.
KMER, BANDS, LENGTH, ALIKE = 5, 24, 3, 0.8
#: Texts of a key up to which it gives its pairs; texts and k-mers of a block on average, and columns of a matrix.
FEW, BLOCK, BLOCK_KMERS, COLUMNS = 12, 384, 300_000, 4096
_SEEDS = np.random.default_rng(50).integers(1 << 63, size=(2, BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def kmers(words: list[str]) -> np.ndarray:
    """Hashes of the k-mers in order; a text of fewer words is one k-mer, an empty one has none."""
    x = symbols(words)
    n = max(1, len(x) - KMER + 1) if len(x) else 0
    out = np.full(n, np.uint64(min(len(x), KMER)))
    for j in range(min(KMER, len(x))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n])
    return out


def labelled(x: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, which occurrence of it this is)."""
    order = np.argsort(x, kind="stable")
    s, place = x[order], np.arange(len(x))
    start = np.ones(len(x), bool)
    start[1:] = s[1:] != s[:-1]
    nth = np.empty(len(x), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(start, place, 0))
    return mixed(x + nth * np.uint64(0xC2B2AE3D27D4EB4F))


def order_min_hash(y: np.ndarray) -> np.ndarray:
    """BANDS keys of labelled k-mers."""
    if not len(y):
        return np.zeros(0, np.int64)
    least = min(LENGTH, len(y))
    keys = np.empty((BANDS, least), np.int64)
    step = max(1, 2_000_000 // len(y))  # so that long texts need no more memory
    for at in range(0, BANDS, step):
        h = (y[None] ^ _SEEDS[0, at : at + step, None]) * _SEEDS[1, at : at + step, None]
        h ^= h >> np.uint64(32)
        keys[at : at + step] = np.argpartition(h, least - 1, axis=1)[:, :least]
    keys.sort(axis=1)  # back to the order of the text
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(least)
    for j in range(least):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + y[keys[:, j]])
    return out.view(np.int64)


def similar(a: list[str], b: list[str], alike: float = ALIKE) -> bool:
    """Whether enough k-mers are common and the alignment is good enough."""
    if a == b:
        return True
    x, y = labelled(kmers(a)), labelled(kmers(b))
    if min(len(x), len(y)) < alike * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    if common < alike * (len(x) + len(y) - common):
        return False
    longest = max(len(a), len(b))
    return edits_within(a, b, int((1 - alike) * longest + 1e-9))


def edits_within(a: list[str], b: list[str], most: int) -> bool:
    """Whether at most so many words need be inserted, deleted or replaced: bit-parallel
    alignment that only sees matches within a band of that width around the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return max(len(a), len(b)) <= most
    n, where = len(a), {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, last, score = (1 << n) - 1, 1 << (n - 1), n
    up, down, band = full, 0, (1 << (2 * most + 1)) - 1
    for j, w in enumerate(b):
        equal = where.get(w, 0)
        if equal:
            equal &= band << (j - most) if j >= most else band >> (most - j)
        across = (((equal & up) + up) ^ up) | equal
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & last:
            score += 1
        elif minus & last:
            score -= 1
        if score - (len(b) - 1 - j) > most:
            return False
        plus, minus, vertical = (plus << 1 | 1) & full, (minus << 1) & full, equal | down
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
    return score <= most


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            grams = [labelled(kmers(FIND(t.as_py()))) for t in part.column("_text")]
            keys = [order_min_hash(g) for g in grams]
            sizes = np.cumsum([0] + [len(k) for k in keys])
            yield pa.record_batch([*(part.column(c) for c in DOC), pa.array([len(g) for g in grams], pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(keys)))], [*DOC, "_n", "_keys"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[str, list[str]] = ("", [])
    for batch in batches:
        linked = []
        for a, b in zip(batch.column("_ta"), batch.column("_tb")):
            ta = a.as_py()
            if ta != last[0]:
                last = (ta, FIND(ta))
            linked.append(similar(last[1], FIND(b.as_py())))
        yield pa.record_batch([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])


def _pairs_linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked of pairs (a, b)."""
    of = lambda c, t: texts.select(F.col("_t").alias(c), F.col("_text").alias(t))
    return staged(pairs.join(of("a", "_ta"), "a").join(of("b", "_tb"), "b").mapInArrow(_verify, "a long, b long, linked boolean"), "verified")


def _plain(text_col: str) -> Column:
    """The text, or the empty one if it has no words."""
    return F.when(F.col(text_col).rlike(WORD), F.col(text_col)).otherwise(F.lit(""))


def text_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _k, _d1 and _d2 (128 bits of the text) and _text."""
    text = _plain(text_col)
    return docs.select(F.col(id_col).alias("_id"), ordered_key(F.col(id_col)).alias("_k"), F.xxhash64(text).alias("_d1"), F.xxhash64(F.lit(7), text).alias("_d2"), text.alias("_text"))


def text_groups(base: DataFrame) -> DataFrame:
    """DOC of each different text's smallest id, _t (the text's number) and _c (the least number of its group of near copies)."""
    first = base.groupBy("_d1", "_d2").agg(F.min("_k").alias("_k"))
    # One id, or none, may have several texts: each has a number of its own, in the ids' order.
    first = staged(first.orderBy(*DOC).select(*DOC, F.monotonically_increasing_id().alias("_t")), "first")
    sketches = staged(base.select(*DOC, "_text").mapInArrow(_sketch, "_k long, _d1 long, _d2 long, _n long, _keys array<long>").join(first, DOC).select("_t", "_n", "_keys").dropDuplicates(["_t"]), "sketches")
    keys = sketches.select("_t", "_n", F.explode("_keys").alias("_key"))
    full = keys.groupBy("_key").agg(F.min(F.struct("_t", "_n")).alias("_least"), F.max("_t").alias("_other")).where("_least._t < _other")
    members = staged(keys.join(full.select("_key", F.col("_least._t").alias("_p"), F.col("_least._n").alias("_pn")), "_key"), "members")
    labels = staged(members.select("_t").distinct().withColumn("_c", F.col("_t")), "groups")
    texts = staged(with_texts(base, first.join(labels, "_t", "left_semi").select(*DOC, "_t")).select("_t", "_text").dropDuplicates(["_t"]), "candidates")

    close = (F.least("_n", "_pn") >= ALIKE * F.greatest("_n", "_pn")) & (F.col("_t") != F.col("_p"))
    ends = [F.least("_t", "_p").alias("a"), F.greatest("_t", "_p").alias("b")]
    known = _pairs_linked(staged(members.where(close).select(*ends).distinct(), "pairs"), texts)
    labels = _joined(labels, known)
    left = _unresolved(members.select("_key", "_t", "_n"), labels)
    if left.isEmpty():
        return _grouped(first, labels)
    left = staged(left.join(_viable(left, texts), "_t"), "viable")
    sizes = left.groupBy("_key").agg(F.count("*").alias("_in"), F.min("_c").alias("_x"), F.max("_c").alias("_y")).where("_x < _y").select("_key", "_in")
    left = staged(left.join(sizes, "_key"), "left")
    pairs = staged(_few_pairs(left.where(F.col("_in") <= FEW)).join(known.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    more = _pairs_linked(pairs, texts).unionByName(_blocks_linked(left.where(F.col("_in") > FEW), texts))
    return _grouped(first, _joined(labels, more))


def _possible(x: Column, y: Column) -> Column:
    """Whether texts (_t, _n, _c, _m) of different groups can be alike, by their numbers of k-mers and
    of those that other groups' texts have: alike ones have ALIKE / (1 + ALIKE) of both's in common."""
    sized = F.least(x["_n"], y["_n"]) >= ALIKE * F.greatest(x["_n"], y["_n"])
    return (x["_c"] != y["_c"]) & sized & (F.least(x["_m"], y["_m"]) >= ALIKE / (1 + ALIKE) * (x["_n"] + y["_n"]) - 1e-6)


def _few_pairs(left: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts of keys with at most FEW."""
    of = left.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_t", "_n", "_c", "_m"))).alias("_all"))
    ends = lambda x: F.transform(F.filter("_all", lambda y: (x["_t"] < y["_t"]) & _possible(x, y)), lambda y: F.struct(x["_t"].alias("a"), y["_t"].alias("b")))
    return of.select(F.explode(F.flatten(F.transform("_all", ends))).alias("_p")).select("_p.*").distinct()


def _blocks_linked(left: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked (true) that join the groups of alike texts in keys with many.

    A text is in one set of keys that texts connect. Sizes in k-mers are cut into bands, so that
    only texts of one band or of neighbouring ones can be alike: each is in the cell of its
    own band and, as a lower one, in the next. Cells are compared in blocks.
    """
    one = left.groupBy("_t", "_n", "_c", "_m").agg(F.min("_key").alias("_k0"))
    edges = left.select("_t", "_key").join(one.select("_t", "_k0"), "_t").select(F.col("_k0").alias("a"), F.col("_key").alias("b")).distinct()
    sets = components(edges).select(F.col("id").alias("_k0"), F.col("component_id").alias("_set"))
    band = F.floor(F.log(F.col("_n").cast("double")) / math.log(1 / (ALIKE - 0.01))).cast("int")
    placed = one.join(sets, "_k0", "left").select("_t", "_n", "_c", "_m", F.coalesce("_set", "_k0").alias("_set"), F.explode(F.array(F.struct(band.alias("_band"), F.lit(False).alias("_low")), F.struct((band + 1).alias("_band"), F.lit(True).alias("_low")))).alias("_x"))
    placed = staged(placed.select("_t", "_n", "_c", "_m", "_set", "_x.*"), "placed")
    cell = ["_set", "_band"]
    cells = placed.groupBy(*cell).agg(F.count("*").alias("_in"), F.sum("_n").alias("_kmers"), F.min("_low").alias("_lower"), F.min("_c").alias("_x"), F.max("_c").alias("_y")).where("_x < _y and not _lower")
    cells = cells.select(*cell, F.ceil(F.greatest(F.col("_in") / BLOCK, F.col("_kmers") / BLOCK_KMERS)).cast("int").alias("_blocks"))
    dealt = placed.join(cells, cell).withColumn("_sub", F.pmod(F.xxhash64("_t"), F.col("_blocks")).cast("int"))
    dealt = dealt.join(texts, "_t").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    dealt = dealt.withColumn("_i", F.least("_sub", "_other")).withColumn("_j", F.greatest("_sub", "_other"))
    keys = [*cell, "_i", "_j"]
    found = dealt.select(*keys, "_t", "_n", "_c", "_m", "_low", "_sub", "_text").groupBy(*keys).applyInArrow(_block_links, "a long, b long")
    return staged(found.distinct().withColumn("linked", F.lit(True)), "block-links")


def _block_links(rows: pa.Table) -> pa.Table:
    t, n, c, m, low, sub = (rows.column(x).to_numpy(zero_copy_only=False) for x in ("_t", "_n", "_c", "_m", "_low", "_sub"))
    possible = c[:, None] != c[None]
    possible &= ~(low[:, None] & low[None]) & (np.minimum.outer(n, n) >= ALIKE * np.maximum.outer(n, n))
    possible &= np.minimum.outer(m, m) >= ALIKE / (1 + ALIKE) * np.add.outer(n, n) - 1e-6
    if (sub != sub[0]).any():  # a block's own pairs are compared where it meets itself
        possible &= sub[:, None] != sub[None]
    some = np.flatnonzero(possible.any(axis=1))
    ends: list[tuple[int, int]] = []
    if len(some):
        words = [FIND(rows.column("_text")[int(r)].as_py()) for r in some]
        common = common_kmers([labelled(kmers(w)) for w in words])
        alike = common >= ALIKE * (np.add.outer(n[some], n[some]) - common)
        group = {x: x for x in c[some].tolist()}

        def top(x: int) -> int:
            while group[x] != x:
                x = group[x]
            return x

        for i, j in np.argwhere(np.triu(possible[np.ix_(some, some)] & alike, 1)).tolist():
            x, y = top(int(c[some[i]])), top(int(c[some[j]]))
            if x != y and edits_within(words[i], words[j], int((1 - ALIKE) * max(len(words[i]), len(words[j])) + 1e-9)):
                group[max(x, y)] = min(x, y)
                ends.append((int(t[some[i]]), int(t[some[j]])))
    return pa.table([pa.array([min(e) for e in ends], pa.int64()), pa.array([max(e) for e in ends], pa.int64())], ["a", "b"])


def common_kmers(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets have in common, from those that several have, COLUMNS at a time."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = times[column] > 1
    row, column = row[many], np.unique(column[many], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(column[b - 1]) + 1 - at)), np.float32)
        part[row[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def _grouped(first: DataFrame, labels: DataFrame) -> DataFrame:
    return first.join(labels, "_t", "left").select(*DOC, "_t", F.coalesce("_c", "_t").alias("_c"))


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members (_key, _t, _n) with their group _c, of keys whose texts aren't all one group."""
    grouped = members.join(labels, "_t")
    split = grouped.groupBy("_key").agg(F.min("_c").alias("_x"), F.max("_c").alias("_y")).where("_x < _y").select("_key")
    return staged(grouped.join(split, "_key", "left_semi"), "open")


def _kmers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t, c, text in zip(batch.column("_t").to_pylist(), batch.column("_c").to_pylist(), batch.column("_text")):
            grams = labelled(kmers(FIND(text.as_py())))
            for at in range(0, len(grams), 1 << 16):
                part = grams[at : at + (1 << 16)]
                yield pa.record_batch([pa.array(np.full(len(part), t)), pa.array(np.full(len(part), c)), pa.array(part.view(np.int64))], ["_t", "_c", "_gram"])


def _viable(left: DataFrame, texts: DataFrame) -> DataFrame:
    """_t and _m, the number of its k-mers that a text of another group in left has too, of the texts of
    left that can have a partner there: _possible for a partner of the least size that any text sharing a key has."""
    least = left.join(left.groupBy("_key").agg(F.min("_n").alias("_m")), "_key").groupBy("_t", "_n", "_c").agg(F.min("_m").alias("_m"))
    needed = ALIKE / (1 + ALIKE) * (F.col("_n") + F.greatest("_m", ALIKE * F.col("_n"))) - 1e-6
    sizes = staged(least.select("_t", "_c", needed.alias("_needed")), "needed")
    grams = staged(texts.join(sizes.select("_t", "_c").hint("shuffle_hash"), "_t").select("_t", "_c", "_text").mapInArrow(_kmers_of, "_t long, _c long, _gram long"), "grams")
    shared = grams.groupBy("_gram").agg(F.min("_c").alias("_x"), F.max("_c").alias("_y")).where("_x < _y").select("_gram")
    common = grams.join(shared, "_gram", "left_semi").groupBy("_t").agg(F.count("*").alias("_m"))
    return common.join(sizes, "_t").where("_m >= _needed").select("_t", "_m")


def _joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """labels (_t, _c) after the groups that linked pairs (a, b) connect have become one."""
    of = lambda c: labels.select(F.col("_t").alias(c), F.col("_c").alias(f"{c}_c"))
    edges = pairs.where("linked").join(of("a"), "a").join(of("b"), "b").select(F.col("a_c").alias("a"), F.col("b_c").alias("b"))
    least = components(edges).select(F.col("id").alias("_c"), F.col("component_id").alias("_to"))
    return staged(labels.join(least, "_c", "left").select("_t", F.coalesce("_to", "_c").alias("_c")), "groups")


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, class_id (the smallest id of its group), kept (id_col = class_id).

    Texts without words, null ones too, are equal; texts of up to four words are near copies only if their words are
    equal. A null id counts as larger than all others and has a null class if all of its group
    are null. Of several texts with one id or with none, each is in the group of its own near copies;
    different groups that have their smallest id in common have the same class_id.
    Repeated rows are kept as they are; an empty table gives no rows; other columns are ignored.
    """
    base = text_keys(docs, id_col, text_col)
    groups = staged(text_groups(base), "text-groups")
    heads = groups.where("_c = _t").select("_d1", "_d2", F.col("_k").alias("_class"), "_c")
    others = groups.where("_c <> _t").select("_d1", "_d2", "_c").join(heads.select("_c", "_class"), "_c")
    of = staged(heads.drop("_c").unionByName(others.drop("_c")), "text-classes")
    out = base.select("_id", "_d1", "_d2").join(of, ["_d1", "_d2"])
    klass = F.when(F.col("_class") < F.lit(2**63 - 1), F.col("_class"))
    return out.select(F.col("_id").alias(id_col), klass.alias("class_id"), F.coalesce(F.col("_id") == klass, F.lit(False)).alias("kept"))


def without_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group, that with the smallest id; repeated rows once."""
    base = text_keys(docs, id_col, text_col)
    chosen = staged(text_groups(base).where("_c = _t").select(*DOC), "chosen")
    copies = base.select(*DOC).groupBy(*DOC).agg(F.count("*").alias("_rows")).where("_rows > 1").join(chosen, DOC, "left_semi").select(*DOC)
    plain = _plain(text_col)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), ordered_key(F.col(id_col)).alias("_k"), F.xxhash64(plain).alias("_d1"), F.xxhash64(F.lit(7), plain).alias("_d2")).join(chosen.hint("shuffle_hash"), DOC, "left_semi")
    copies = staged(copies, "repeated-rows")
    if not copies.isEmpty():
        rows = rows.join(copies, DOC, "left_anti").unionByName(rows.join(copies, DOC, "left_semi").dropDuplicates(DOC))
    return rows.select("_row.*")
