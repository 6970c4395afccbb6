"""Byte passages that occur more than once, found by a logarithmic family of sparse suffix tables.

A level of the family is a table of suffixes: only those at anchors (which every passage of the
threshold's length has), by the key of the bytes they begin with, in the order of their keys. A
new batch becomes a level: it is merge-scanned against the existing levels for keys that both
have, and levels of about equal size are merged into one, so that there are only logarithmically
many and each suffix is rewritten as often.

A passage around an anchor has 168 bytes before it or 232 from it on, so each anchor has up to two
keys, of the 232 bytes on either side. Where a key occurs again, the passages whose anchors it stands
for (each passage has one) are compared, in three steps of hashes that any number of tasks can sum: by all that the passages
of a side span; where that differs, BLOCK passages at a time, by the bytes that all of them have
and by what they span; and one by one where the former are equal and the latter aren't. Of
contexts that are equal as a whole, one goes on to the next step. No step holds a key's contexts
together, and their bytes stay with the texts. Texts that occur several times, in whatever
batches, are told by digests: all of their passages repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._anchors import CHUNK, DOC, classes, grams, hits, keyed, mixed, shared_anchors, signed, window_anchors, with_texts
from ._shared import drop, dropped, fresh_folder, staged

#: Bytes of an anchor's hash; passages that are compared at a time (fewer than 16).
GRAM, BLOCK = 64, 14
#: Bits of how far before its anchor a passage starts. A packed place: twice the anchor's place (and 1 more for
#: the side from it on), and how far before it the first and the last of its passages start.
BITS = 12
LEVEL = "_anchor long, _k long, _d1 long, _d2 long, _places array<long>"
_values = np.random.default_rng(20).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def symbols(text: str) -> tuple[bytes, np.ndarray]:
    data = text.encode("utf-8", "replace")
    return data, _values[np.frombuffer(data, np.uint8)]


def side_keys(x: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, packed places) of the anchors of x: side 0 has more than half of what a window of n
    has besides the anchor before it, side 1 from it on."""
    half = (n - GRAM) // 2
    size = n - half  # bytes that all windows of a side share
    for first in range(0, len(x) - n + 1, CHUNK):
        part = x[first : first + CHUNK + n - 1]
        h = grams(part, GRAM)
        for _, p, _ in window_anchors(part, GRAM, n):
            p, u = np.unique(p, return_index=True)
            v = np.append(u[1:], len(part) - n + 1) - 1  # the windows that have it as their anchor start in u..v
            for side, start in ((0, p - half), (1, p)):
                a, b = (np.maximum(u, p - half + 1), v) if side else (u, np.minimum(v, p - half))
                there = a <= b
                at = start[there]
                key = h[at] * np.uint64(0xC2B2AE3D27D4EB4F)
                for more in [*range(GRAM, size - GRAM, GRAM), size - GRAM]:
                    key = mixed(key + h[at + more])
                far = ((p - a) << BITS) | (p - b)
                yield signed(mixed(key + np.uint64(side))), ((2 * (p + first) + side) << 2 * BITS | far)[there]


def unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place, side, first and last start."""
    mask, place = (1 << BITS) - 1, packed >> 2 * BITS + 1
    return place, packed >> 2 * BITS & 1, place - (packed >> BITS & mask), place - (packed & mask)


def _anchors(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """LEVEL rows of texts: a row for each different key of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, found, places, sizes = batch.slice(at, 256), [], [], []
                for text in part.column("_text"):
                    some = list(side_keys(symbols(text.as_py())[1], n))
                    keys, where = (np.concatenate(x) for x in zip(*some)) if some else (np.zeros(0, np.int64),) * 2
                    own, count = np.unique(keys, return_counts=True)
                    found.append(own)
                    sizes.append(count)
                    places.append(where[np.argsort(keys, kind="stable")])
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                ends = np.cumsum(np.concatenate([[0], *sizes]))
                yield pa.record_batch([pa.array(np.concatenate(found), pa.int64()), *(part.column(c).take(rows) for c in DOC), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(places), pa.int64()))], ["_anchor", *DOC, "_places"])

    return run


_powers: list[np.ndarray] = []


def range_hashes(x: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int) -> np.ndarray:
    """Hashes of x[start:end], of ranges of at most longest symbols, wherever they stand: differences
    of running sums of powers, CHUNK symbols at a time."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            power = np.full(CHUNK + (1 << 16), np.uint64(base))
            power[0] = 1
            _powers.append(np.cumprod(power))
    up, down = _powers
    out = np.zeros(len(start), np.uint64)
    for chunk in np.unique(start // CHUNK).tolist():
        some, first = np.flatnonzero(start // CHUNK == chunk), chunk * CHUNK
        part = x[first : first + CHUNK + longest]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        out[some] = (sums[end[some] - first] - sums[start[some] - first]) * down[start[some] - first]
    return mixed(out + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _with(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    return mixed(h ^ (more.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


CONTEXT = "_key long, _hull long, _t long, _at long"


def _contexts(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each anchor in _hits: the hash of all that the passages on its side span."""

    def of(x: np.ndarray, found: list[dict]) -> tuple[np.ndarray, ...]:
        at = np.asarray([p for f in found for p in f["_places"]], np.int64)
        anchor = np.repeat(np.asarray([f["_anchor"] for f in found], np.int64), [len(f["_places"]) for f in found])
        place, _, first, last = unpacked(at)
        hull = range_hashes(x, first, last + n, 2 * n)
        return anchor, signed(_with(_with(hull, place - first), place - last)), at

    return _by_text(of)


def _by_text(of) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """CONTEXT rows: of(symbols, _hits) gives key, hash and place of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, c = of(symbols(batch.column("_text")[i].as_py())[1], batch.column("_hits")[i].as_py())
                for at in range(0, len(a), 1 << 15):
                    cut = slice(at, at + (1 << 15))
                    yield pa.record_batch([pa.array(a[cut]), pa.array(b[cut]), pa.array(np.full(len(a[cut]), batch.column("_t")[i].as_py())), pa.array(c[cut])], ["_key", "_hull", "_t", "_at"])

    return run


def _blocks(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each anchor in _hits, for each BLOCK consecutive passages around it: a hash of the bytes that any
    BLOCK passages there have, and one of what its own span. _at: 16 times the first start, and how many more there are."""
    reach = n - GRAM

    def of(x: np.ndarray, found: list[dict]) -> tuple[np.ndarray, ...]:
        key, at = (np.asarray([f[c] for f in found], np.int64) for c in ("_key", "_at"))
        place, _, start, end = unpacked(at)
        low = place[:, None] - reach + BLOCK * np.arange(reach // BLOCK + 1)
        high = np.minimum(low + BLOCK - 1, place[:, None])
        first, last = np.maximum(low, start[:, None]), np.minimum(high, end[:, None])
        row, block = np.nonzero(first <= last)
        low, high, first, last = (c[row, block] for c in (low, high, first, last))
        core = _with(_with(range_hashes(x, high, low + n, n), key[row]), block)
        hull = _with(_with(range_hashes(x, first, last + n, 2 * n), first - low), last - low)
        return signed(core), signed(hull), first << 4 | last - first

    return _by_text(of)


def _passages(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The passages of the blocks in _hits. _at: their starts, times 16."""

    def of(x: np.ndarray, found: list[dict]) -> tuple[np.ndarray, ...]:
        core, at = (np.asarray([f[c] for f in found], np.int64) for c in ("_key", "_at"))
        first, many = at >> 4, (at & 15) + 1
        start = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(core, many), signed(range_hashes(x, start, start + n, n)), start << 4

    return _by_text(of)


def _met(rows: DataFrame, what: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of CONTEXT rows: those (_t, _at) that share _key and _hull; and, of keys with several different
    _hull, a row (_t, _key, _at) of each; and the groups, which the last is read from."""
    groups = rows.groupBy("_key", "_hull").agg(F.count("*").alias("_n"), F.min(F.struct("_t", "_at")).alias("_one"))
    groups = staged(groups, what)
    runs = staged(rows.join(groups.where("_n > 1").select("_key", "_hull"), ["_key", "_hull"], "left_semi").select("_t", "_at"), "runs")
    drop(rows)
    several = groups.groupBy("_key").agg(F.min("_hull").alias("_x"), F.max("_hull").alias("_y")).where("_x < _y").select("_key")
    return runs, groups.join(several, "_key", "left_semi").select("_one._t", "_key", "_one._at"), groups


def repeated_runs(base: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """DOC, _first and _last starts of runs of passages that occur elsewhere too, of the texts of base
    at the anchors in found (DOC, _hits of _anchor and _places)."""
    found = staged(found.withColumn("_t", F.monotonically_increasing_id()), "found")
    number = found.select("_t", *DOC)

    def hashed(differ: DataFrame, how, what: str) -> DataFrame:
        of = differ.groupBy("_t").agg(F.collect_list(F.struct("_key", "_at")).alias("_hits")).join(number, "_t")
        return staged(with_texts(base, of).mapInArrow(how(n), CONTEXT), what)

    contexts = staged(with_texts(base, found).mapInArrow(_contexts(n), CONTEXT), "contexts")
    whole, differ, groups = _met(contexts, "equal-contexts")
    blocks = hashed(differ, _blocks, "blocks")
    drop(groups)
    some, differ, groups = _met(blocks, "equal-blocks")
    passages = hashed(differ, _passages, "passages")
    drop(groups)
    again = passages.groupBy("_key", "_hull").agg(F.count("*").alias("_n")).where("_n > 1").select("_key", "_hull")
    one = passages.join(again, ["_key", "_hull"], "left_semi").select("_t", "_at")
    place = F.shiftright("_at", 2 * BITS + 1)
    far = lambda bits: place - F.shiftright("_at", bits).bitwiseAND(F.lit((1 << BITS) - 1))
    start = F.shiftright("_at", 4)
    runs = whole.select("_t", far(BITS).alias("_first"), far(0).alias("_last")).unionByName(some.unionByName(one).select("_t", start.alias("_first"), (start + F.col("_at").bitwiseAND(F.lit(15))).alias("_last")))
    out = staged(runs.join(number, "_t").select(*DOC, "_first", "_last"), "runs")
    drop(passages, whole, some, found)
    return out


class Levels:
    """The family: one table of suffixes a level, smallest first, in a folder that outlives the batches.
    The batches' rows must stay readable, as later ones may need their texts."""

    def __init__(self, spark: SparkSession, n: int, path: str | None = None):
        self.spark, self.n, self.path = spark, n, path or fresh_folder(spark, "levels")
        self.levels: list[tuple[int, str]] = []
        #: Of each batch: its rows, its texts, those that no earlier batch has, and its runs.
        self.batches: list[tuple[DataFrame, DataFrame, DataFrame, DataFrame]] = []

    def add_batch(self, base: DataFrame) -> None:
        """The rows of a batch (as keyed gives them): runs of what it has in common with itself and with
        earlier ones, in both; and its suffixes as a new level."""
        texts = staged(classes(base), "texts")
        suffixes = base.select(*DOC, "_text").mapInArrow(_anchors(self.n), LEVEL)
        new = texts
        if self.batches:
            new = staged(texts.join(_union(b[1] for b in self.batches).select("_d1", "_d2"), ["_d1", "_d2"], "left_anti"), "new-texts")
            suffixes = suffixes.join(new.select(F.col("_first").alias("_k"), "_d1", "_d2"), DOC, "left_semi")
        name, level = self._written(suffixes)
        value = F.struct("_anchor", "_places")
        times = level.withColumn("_times", F.size("_places"))
        shared = shared_anchors(times, within=True).select("_anchor")
        if self.levels:
            keys = level.select("_anchor").distinct()
            earlier = staged(self.suffixes().join(keys, "_anchor", "left_semi"), "met-suffixes")  # the merge scan
            shared = staged(shared.unionByName(earlier.select("_anchor")).distinct(), "shared")
            there = _found(earlier, _union(b[2] for b in self.batches), value)
            here = _found(level.join(shared, "_anchor", "left_semi"), new, value)
            found = here.unionByName(there)
        else:
            found = hits(times, shared, texts, value)
        self.batches.append((base, texts, new, repeated_runs(_union([base, *(b[0] for b in self.batches)]), found, self.n)))
        self._add(name, level.count())

    def _written(self, suffixes: DataFrame) -> tuple[str, DataFrame]:
        """A table of suffixes in the order of keys; hot keys may be in several of its files."""
        name = f"{self.path}/{fresh_folder(self.spark, 'level').rsplit('/', 1)[1]}"
        suffixes.hint("rebalance", "_anchor").sortWithinPartitions("_anchor").write.parquet(name)
        return name, self._read(name)

    def _add(self, name: str, count: int) -> None:
        """Levels that aren't twice as large as what comes are merged with it."""
        while self.levels and self.levels[0][0] < 2 * count:
            size, other = self.levels.pop(0)
            merged, _ = self._written(self._read(name).unionByName(self._read(other)))
            for old in (name, other):
                dropped(self.spark, old)
            name, count = merged, count + size
        self.levels.insert(0, (count, name))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(name)

    def suffixes(self) -> DataFrame:
        return _union(self._read(name) for _, name in self.levels)

    def rows(self) -> DataFrame:
        return _union(b[0] for b in self.batches)

    def texts(self) -> DataFrame:
        """_d1, _d2, _copies of each text of all batches."""
        texts = _union(b[1].select("_d1", "_d2", "_copies") for b in self.batches)
        return texts if len(self.batches) == 1 else texts.groupBy("_d1", "_d2").agg(F.sum("_copies").alias("_copies"))

    def repeats(self) -> DataFrame:
        """DOC, _first and _last starts of runs of passages that occur elsewhere in the family."""
        return _union(b[3] for b in self.batches)


def _found(suffixes: DataFrame, texts: DataFrame, value: Column) -> DataFrame:
    """DOC, _hits of the suffixes of each text's first row."""
    first = texts.select(F.col("_first").alias("_k"), "_d1", "_d2")
    return suffixes.groupBy(*DOC).agg(F.collect_list(value).alias("_hits")).join(first, DOC, "left_semi")


def _removed(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, runs in zip(batch.column("_text"), batch.column("_runs")):
                data = text.as_py().encode("utf-8", "replace")
                edge = np.zeros(len(data) + 1, np.int64)
                for r in runs.as_py():
                    edge[r["_first"]] += 1
                    edge[r["_last"] + n] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
            yield pa.record_batch([*(batch.column(c) for c in DOC), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string())], [*DOC, "_removed", "_spans", "_kept"])

    return run


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def repeat_digests(docs: DataFrame, *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, n_bytes, n_removed, n_spans, kept_sha256, after the
    removal of every byte that a string of length bytes covers which starts elsewhere too, in
    this text or another row's.

    Null and empty texts have no bytes. Ids play no part, so null and repeated ones are fine;
    repeated rows are texts that occur again. An empty table gives no rows; other columns are
    ignored. Texts of any length are handled whole; matches never cross rows.
    """
    return batch_digests([docs], length=length, id_col=id_col, text_col=text_col)


def batch_digests(batches: list[DataFrame], *, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """repeat_digests of all batches' rows together, as the family finds it batch after batch."""
    if not 2 * GRAM <= length < 1 << BITS:
        raise ValueError(f"a passage has {2 * GRAM} to {(1 << BITS) - 1} bytes")
    family = Levels(batches[0].sparkSession, length)
    for docs in batches:
        family.add_batch(keyed(docs, id_col, text_col))
    base, texts = family.rows(), family.texts()
    runs = family.repeats().groupBy(*DOC).agg(F.collect_set(F.struct("_first", "_last")).alias("_runs"))
    done = with_texts(base, runs).mapInArrow(_removed(length), "_k long, _d1 long, _d2 long, _removed long, _spans long, _kept string").dropDuplicates(DOC)
    size = F.octet_length("_text").cast("long")
    light = base.select("_id", *DOC, size.alias("n_bytes"), F.sha2("_text", 256).alias("_plain"))
    gone = (F.col("_copies") > 1) & (F.col("n_bytes") >= length)
    out = light.join(texts, ["_d1", "_d2"]).join(done, DOC, "left")
    pick = lambda whole, found, plain: F.when(gone, whole).otherwise(F.coalesce(F.col(found), plain))
    return out.select(F.col("_id").alias(id_col), "n_bytes", pick(F.col("n_bytes"), "_removed", F.lit(0)).alias("n_removed"), pick(F.lit(1), "_spans", F.lit(0)).cast("long").alias("n_spans"), pick(F.sha2(F.lit(""), 256), "_kept", F.col("_plain")).alias("kept_sha256"))
