"""Removal of word passages that earlier documents have.

A passage is a window of consecutive words; every word of a window that also starts in a
document with a smaller id goes. Windows are compared by 128 bits of hash, of the window and
of its anchor, but only where the anchor is in different texts: a tenth of all windows. Copies
of a whole text are told by digests and need no windows.

The automata of reference shards that this operator was asked for are here too, for a
reference of bounded size (remove_reference): broadcast to every task, with documents streamed
through them. When the reference is the corpus itself, what is broadcast would grow with the
corpus and every document would meet every shard, so the corpus is compared by anchors instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import DOC, classes, grams, hits, keyed, mixed, shared_anchors, signed, window_anchors, with_texts
from ._shared import GAP, WORD, ordered_key, staged
from .mixing import word_count

#: Words of an anchor's hash: 16 are seldom alike by chance and leave 35 places in a window of 50.
GRAM = 16
FIND = re.compile(WORD).findall


class _Hashes(dict):
    """Hashes of words, kept for the next time."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


_hashes = _Hashes()


def symbols(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def window_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n symbols, from those of the powers of two in n."""
    out, at, size = np.zeros(max(0, len(x) - n + 1), np.uint64), 0, 1
    while size <= n:
        if n & size:
            h = mixed(grams(x, size) + np.uint64(size))
            out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[at : at + len(out)]
            at += size
        size *= 2
    return mixed(out)


def _anchors(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    k = gram(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = []
                for text in part.column("_text"):
                    x = symbols(FIND(text.as_py()))
                    own = [np.unique(h) for _, _, h in window_anchors(x, k, n)]
                    found.append(np.unique(np.concatenate(own)) if own else np.zeros(0, np.uint64))
                rows = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.record_batch([pa.array(signed(np.concatenate(found)), pa.int64()), *(part.column(c).take(pa.array(rows)) for c in DOC), pa.array(np.ones(len(rows), np.int64))], ["_anchor", *DOC, "_times"])

    return run


def _windows(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows whose anchors are in _hits: _window, _anchor, DOC, _start."""
    k = gram(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = symbols(FIND(batch.column("_text")[i].as_py()))
                wanted = np.sort(np.asarray(batch.column("_hits")[i].as_py(), np.int64))
                for first, _, h in window_anchors(x, k, n):
                    anchor = signed(h)
                    near = np.minimum(np.searchsorted(wanted, anchor), len(wanted) - 1)
                    start = np.flatnonzero(wanted[near] == anchor)
                    if len(start):
                        hashes = signed(window_hashes(x[first : first + len(h) + n - 1], n))[start]
                        one = [pa.array(np.full(len(start), batch.column(c)[i].as_py(), np.int64)) for c in DOC]
                        yield pa.record_batch([pa.array(hashes), pa.array(anchor[start]), *one, pa.array(start + first)], ["_window", "_anchor", *DOC, "_start"])

    return run


def gram(n: int) -> int:
    k = GRAM
    while k > max(1, n // 2):
        k //= 2
    return k


def covered(starts: np.ndarray, size: int, count: int) -> np.ndarray:
    """Which of count places some run of size from starts covers."""
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + size, count), -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(n: int, texts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """DOC, _removed and the kept words, or their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, out = [], []
            for text, starts in zip(batch.column("_text"), batch.column("_starts")):
                words = FIND(text.as_py())
                gone = covered(np.asarray(starts.as_py(), np.int64), n, len(words))
                kept = " ".join([w for w, g in zip(words, gone.tolist()) if not g])
                removed.append(int(gone.sum()))
                out.append(kept if texts else hashlib.sha256(kept.encode("utf-8", "replace")).hexdigest())
            yield pa.record_batch([*(batch.column(c) for c in DOC), pa.array(removed, pa.int64()), pa.array(out, pa.string())], [*DOC, "_removed", "_out"])

    return run


def repeated_windows(base: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """DOC and _starts, the windows that documents with smaller ids have too, for first documents of a text."""
    anchors = staged(base.select(*DOC, "_text").mapInArrow(_anchors(n), "_anchor long, _k long, _d1 long, _d2 long, _times long"), "anchors")
    found = hits(anchors, shared_anchors(anchors, within=False), texts, F.col("_anchor"))
    windows = staged(with_texts(base, found).mapInArrow(_windows(n), "_window long, _anchor long, _k long, _d1 long, _d2 long, _start long"), "windows")
    first = windows.groupBy("_window", "_anchor").agg(F.min("_k").alias("_least"), F.max("_k").alias("_most")).where("_least < _most").drop("_most")
    return windows.join(first, ["_window", "_anchor"]).where("_k > _least").groupBy(*DOC).agg(F.collect_set("_start").alias("_starts"))


def passage_digests(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, n_words, n_removed, kept_sha256.

    Null and empty texts have no words. A null id is larger than all others, so that nothing
    is ever removed for its sake; rows with one id count as one document, so copies under one
    id stay. Repeated rows get equal results. An empty table gives no rows; other columns are
    ignored. Texts of any length are handled whole.
    """
    base = keyed(docs, id_col, text_col)
    texts = staged(classes(base), "texts")
    marks = repeated_windows(base, texts, window)
    done = with_texts(base, marks).mapInArrow(_kept(window, texts=False), "_k long, _d1 long, _d2 long, _removed long, _out string").dropDuplicates(DOC)
    plain = F.regexp_replace(F.regexp_replace("_text", rf"\A{GAP}|{GAP}\z", ""), GAP, " ")
    light = base.select("_id", *DOC, word_count(F.col("_text")).alias("n_words"), F.sha2(plain, 256).alias("_plain"))
    all_gone = (F.col("_first") < F.col("_k")) & (F.col("n_words") >= window)
    out = light.join(texts.select("_d1", "_d2", "_first"), ["_d1", "_d2"]).join(done, DOC, "left")
    return out.select(F.col("_id").alias(id_col), "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("_removed", F.lit(0))).alias("n_removed"), F.when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("_out", "_plain")).alias("kept_sha256"))


def without_passages(docs: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the kept words as texts, joined by single spaces, where any word was removed;
    other texts stay as they are, and documents of which nothing is left go. Cases as above."""
    base = keyed(docs, id_col, text_col)
    texts = staged(classes(base), "texts")
    marks = repeated_windows(base, texts, window)
    done = staged(with_texts(base, marks).mapInArrow(_kept(window, texts=True), "_k long, _d1 long, _d2 long, _removed long, _out string").dropDuplicates(DOC), "kept")
    # What changes: texts that lose words, and copies of texts that a smaller id has.
    copies = base.select(*DOC).join(texts.where("_copies > 1"), ["_d1", "_d2"]).where("_first < _k").select(*DOC, F.lit(0).cast("long").alias("_removed"), F.lit(None).cast("string").alias("_out")).distinct()
    text = F.col(text_col)
    filled = F.coalesce(text, F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), text.alias("_was"), (word_count(text) >= window).alias("_long"), ordered_key(F.col(id_col)).alias("_k"), F.xxhash64(filled).alias("_d1"), F.xxhash64(F.lit(7), filled).alias("_d2"))
    out = rows.join(done.unionByName(copies).hint("shuffle_hash"), DOC, "left")
    changed = F.col("_removed").isNotNull() & F.col("_long")
    out = out.where(~F.coalesce(changed & (F.coalesce("_out", F.lit("")) == ""), F.lit(False))).withColumn("_changed", F.coalesce(changed, F.lit(False)))
    new = {text_col: F.when(F.col("_changed"), F.col("_out")).otherwise(F.col("_was"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_changed"), F.char_length("_out").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


class Automaton:
    """The suffix automaton of several word sequences: every substring of them is a path."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, word: str) -> int:
        """The state of p's longest substring with word behind it, split off if longer ones share it."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        short = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = short
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = short
            p = self.link[p]
        return short

    def add(self, words: list[str]) -> None:
        last = 0
        for word in words:
            if word in self.next[last]:
                last = self._split(last, word)
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, word)
            last = new

    def statistics(self, words: list[str]) -> Iterator[int]:
        """At each word, the length of the longest substring of the sequences that ends there."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield length


#: Words of a reference, which goes to every task, at most; and of one automaton of it.
REFERENCE_WORDS, AUTOMATON_WORDS = 1_000_000, 100_000


def remove_reference(docs: DataFrame, reference: DataFrame, *, window: int = 50, id_col: str = "doc_id", text_col: str = "text", reference_col: str = "text") -> DataFrame:
    """id_col, n_removed and text, a row for each input row: without the maximal spans of at
    least window words that texts of the reference have.

    The reference must have at most REFERENCE_WORDS words, or a ValueError says so: its automata,
    one for each shard of texts, are sent to every task. Null texts have no words; texts that
    lose nothing stay as they are; repeated rows and null ids are kept.
    """
    total = reference.agg(F.sum(word_count(F.col(reference_col)))).first()[0] or 0
    if total > REFERENCE_WORDS:
        raise ValueError(f"the reference has {total} words; at most {REFERENCE_WORDS} can be sent to all tasks")
    shards, held = [Automaton()], 0
    for (text,) in reference.select(reference_col).where(F.col(reference_col).isNotNull()).collect():
        words = FIND(text)
        if held and held + len(words) > AUTOMATON_WORDS:
            shards.append(Automaton())
            held = 0
        shards[-1].add(words)
        held += len(words)
    sent = docs.sparkSession.sparkContext.broadcast([(a.next, a.link, a.length) for a in shards])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = []
        for parts in sent.value:
            automata.append(Automaton())
            automata[-1].next, automata[-1].link, automata[-1].length = parts
        for batch in batches:
            removed, out = [], []
            for text in batch.column("_text").to_pylist():
                words = FIND(text or "")
                edge = np.zeros(len(words) + 1, np.int64)
                for automaton in automata:
                    for at, length in enumerate(automaton.statistics(words)):
                        if length >= window:
                            edge[at - length + 1] += 1
                            edge[at + 1] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                out.append(" ".join([w for w, g in zip(words, gone.tolist()) if not g]) if gone.any() else text)
            yield pa.record_batch([batch.column("_id"), pa.array(removed, pa.int64()), pa.array(out, pa.string())], ["_id", "n_removed", "text"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, n_removed long, text string").withColumnRenamed("_id", id_col)
