"""Anchors: positions that a window chooses by its content alone.

Each window of n symbols has the position of its smallest hash of k symbols (the first, if
several are equal) as its anchor, so equal windows, wherever they stand, have equal anchors
at equal places. Two windows can only be equal if their anchors' hashes are; hashes that one
document alone has can be left out. About 2 of n - k + 2 positions are anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import ordered_key, staged

#: Windows handled at a time, so that very long texts need no more memory; bits for a place among them.
CHUNK, PLACE = 1 << 20, 22
_ODD = 0x9E3779B97F4A7C15


def grams(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k symbols (uint64), k a power of two, by doubling."""
    size, base = 1, _ODD
    while size < k:
        x = x[: len(x) - size] * np.uint64(base) + x[size:]
        size, base = 2 * size, base * base % (1 << 64)
    return x


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def window_anchors(x: np.ndarray, k: int, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of windows of n symbols of x: (first window, anchors' places, anchors' hashes)."""
    place = np.uint64((1 << PLACE) - 1)
    for first in range(0, len(x) - n + 1, CHUNK):
        h = mixed(grams(x[first : first + CHUNK + n - 1], k))
        least = sliding_min((h & ~place) | np.arange(len(h), dtype=np.uint64), n - k + 1)
        at = (least & place).astype(np.int64)
        yield first, at + first, h[at]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# Documents as the operators on repeats see them.

DOC = ["_k", "_d1", "_d2"]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _k (the id, nulls last), _d1 and _d2 (128 bits of the text) and _text (null: empty)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("_id"), ordered_key(F.col(id_col)).alias("_k"), F.xxhash64(text).alias("_d1"), F.xxhash64(F.lit(7), text).alias("_d2"), text.alias("_text"))


def classes(base: DataFrame) -> DataFrame:
    """For each text: _first, the smallest _k that has it, and _copies."""
    return base.groupBy("_d1", "_d2").agg(F.min("_k").alias("_first"), F.count("*").alias("_copies"))


def shared_anchors(anchors: DataFrame, within: bool) -> DataFrame:
    """Anchors (a row for each document: _anchor, DOC, _times) that different texts have or, if
    within, one text has several times. Map-side sums: a hot anchor is a row from each task."""
    sums = [f(c).alias(f"{f.__name__}{c}") for c in ("_d1", "_d2") for f in (F.min, F.max)]
    spread = (F.col("min_d1") != F.col("max_d1")) | (F.col("min_d2") != F.col("max_d2"))
    spread = spread | (F.col("_most") > 1) if within else spread
    return anchors.groupBy("_anchor").agg(*sums, F.max("_times").alias("_most"), F.sum("_times").alias("_all")).where(spread).select("_anchor", "_all")


def hits(anchors: DataFrame, shared: DataFrame, texts: DataFrame, value: Column) -> DataFrame:
    """For the first document of each text that has shared anchors: DOC, _hits (value of each)."""
    found = anchors.join(shared, "_anchor").groupBy(*DOC).agg(F.collect_set(value).alias("_hits"))
    first = texts.select(F.col("_first").alias("_k"), "_d1", "_d2")
    return found.join(first, DOC, "left_semi")


#: Words of a filter's bits: its size is fixed, so sending it to all executors is safe.
FILTER_WORDS = 1 << 15


def likely(base: DataFrame, keys: DataFrame) -> DataFrame:
    """base without most rows whose (_d1, _d2) isn't in keys: a bit for each key, in FILTER_WORDS
    words of 64. With very many keys it keeps everything, which a join then sorts out."""
    word, bit = F.shiftright(F.col("_d1").bitwiseAND(F.lit(FILTER_WORDS * 64 - 1)), 6), F.expr("shiftleft(1L, cast(_d1 & 63 as int))")
    words = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    held = F.broadcast(staged(words, "filter"))  # at most FILTER_WORDS rows
    return base.withColumn("_word", word).join(held, "_word").where(F.col("_bits").bitwiseAND(bit) != 0).drop("_word", "_bits")


def with_texts(base: DataFrame, keys: DataFrame) -> DataFrame:
    """keys (DOC and more) with their texts: what may match is shuffled, and streamed past the keys."""
    keys = staged(keys, "keys")
    return likely(base.select(*DOC, "_text"), keys).join(keys.hint("shuffle_hash"), DOC)
