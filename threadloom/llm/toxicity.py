"""Toxicity by class-conditional Kneser-Ney models.

Two character models, of toxic and of ordinary texts, give each character of a word a
probability after the up to six before it. A word counts once a document, so that one
document's repetitions are no evidence. Both models discount their own counts and give what
is left, and a fixed mass besides, to one shared model, counted over all documents, labelled
or not, which backs off to its Kneser-Ney continuation counts: what neither class has seen
often costs both the same. A text's score comes from the difference of its log-likelihoods,
over the words that one class makes much likelier as toxic, divided by the number of words.

What is fitted on labels uses at most SAMPLE rows of each label, by hash of the id, and of those
as many as have SAMPLE_BYTES together; all counts of the shared model cover every row. At most
ENTRIES entries of the model, those that the classes see most often, are an Arrow table on the
driver, of which tasks make dictionaries. The others stay a table: the corpus's different words
are joined with it, and texts with the words that it gives another value.
"""

from __future__ import annotations

import math
import string
from collections import ChainMap, Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import staged

#: Labelled rows of each label that are used at most, and their bytes; folds of crc32(id) and which are for what.
SAMPLE, SAMPLE_BYTES, FOLDS, HELD_OUT, CALIBRATION = 20_000, 100_000_000, 5, 0, 1
#: Characters before the one that is predicted; the discount and the mass that the shared
#: model has besides; a word that isn't e ** NEUTRAL times likelier as toxic says nothing;
#: counts under LEAST are left to the shared model; a gram whose log ratio is within SLIGHT of
#: what its context gives to unseen ones needs no entry.
BEFORE, DISCOUNT, MASS, NEUTRAL, LEAST, SLIGHT = 6, 0.75, 20, 3.0, 3, 0.05
#: Distinct words that a task holds before it passes its counts on; entries that tasks hold at most; bits of a filter.
HELD_WORDS, ENTRIES, FILTER = 250_000, 2_000_000, 1 << 25

WORDS = regex.compile(r"\p{L}+")
#: Lower-case letters of ASCII and the bytes of other characters; blanks elsewhere.
PIECE = bytes(b if b >= 0x80 or chr(b) in string.ascii_lowercase else 32 for b in range(256))
COUNTS = ["n_all", "n_toxic", "n_plain"]


def words_of(text: str) -> list[str]:
    """The lower-cased runs of letters of a text, in order."""
    pieces = text.lower().encode().translate(PIECE).decode().split()
    if all(map(str.isalpha, pieces)):
        return pieces
    return [w for p in pieces for w in ((p,) if p.isalpha() else WORDS.findall(p))]


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def head_grams(head: str) -> list[str]:
    """The grams that end within a word's first BEFORE - 1 characters: words share most of them."""
    s = "^" + head
    return [s[:i] for i in range(2, len(s) + 1)]


def tail_grams(word: str) -> list[str]:
    """The others: of the later characters and the word's end."""
    s, wide = "^" + word + "$", BEFORE + 1
    return [s[max(0, i - wide) : i] for i in range(min(BEFORE, len(s) - 1) + 1, len(s) + 1)]


def _counts(of: str, found: tuple[dict[str, int], ...]) -> Iterator[pa.RecordBatch]:
    names = list(found[0])  # of all documents, so all names
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.record_batch([pa.array(part, pa.string()), *(pa.array([f.get(x, 0) for x in part], pa.int64()) for f in found)], [of, *COUNTS])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter, Counter] = (Counter(), Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column("_text"), batch.column("_label")):
            words, label = set(words_of(text.as_py())), label.as_py()
            counts[0].update(words)
            if label is not None:
                counts[1 if label else 2].update(words)
            if len(counts[0]) > HELD_WORDS:
                yield from _counts("word", counts)
                for c in counts:
                    c.clear()
    yield from _counts("word", counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: tuple[dict[str, int], ...] = ({}, {}, {})
    for batch in batches:
        words = batch.column("word").to_pylist()
        for column, grams in zip(COUNTS, found):
            get, heads = grams.get, Counter()
            for w, n in zip(words, batch.column(column).to_pylist()):
                if n:
                    heads[w[: BEFORE - 1]] += n
                    for g in tail_grams(w):
                        grams[g] = get(g, 0) + n
            for head, n in heads.items():
                for g in head_grams(head):
                    grams[g] = get(g, 0) + n
        if len(found[0]) > 2 * HELD_WORDS:
            yield from _counts("gram", found)
            for grams in found:
                grams.clear()
    yield from _counts("gram", found)


def _summed(counts: DataFrame, of: str) -> DataFrame:
    return staged(counts.groupBy(of).agg(*(F.sum(c).alias(c) for c in COUNTS)), f"toxicity-{of}s")


def sample_labels(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_lid, _label, _fold of at most SAMPLE rows of each label outside the held-out fold, and
    of several with the same text only one: copies must not outvote other texts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_lid")).agg(F.max("toxic").alias("_label")).withColumn("_fold", fold(F.col("_lid"))).where(F.col("_fold") != HELD_OUT)
    some = [known.where(F.col("_label") == k).orderBy(F.xxhash64("_lid"), "_lid").limit(SAMPLE) for k in (0, 1)]
    some = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * SAMPLE rows of a few bytes
    texts = docs.select(F.col(id_col).alias("_lid"), F.xxhash64(F.col(text_col)).alias("_digest"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes")).join(some, "_lid")
    once = texts.groupBy("_digest").agg(F.min(F.struct("_lid", "_label", "_fold", "_bytes")).alias("_x")).select("_x.*").groupBy("_lid", "_label", "_fold").agg(F.sum("_bytes").alias("_bytes"))
    running = F.sum("_bytes").over(Window.partitionBy("_label").orderBy(F.xxhash64("_lid"), "_lid"))  # over at most SAMPLE rows
    return staged(once.withColumn("_upto", running).where((F.col("_upto") <= SAMPLE_BYTES) | (F.col("_upto") == F.col("_bytes"))).select("_lid", "_label", "_fold"), "toxicity-sample")


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model, from the texts of docs and labels (id_col, toxic). It holds for the words of docs."""
    chosen = sample_labels(docs, labels, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    rows = docs.select(F.col(id_col).alias("_lid"), text)
    schema = "{} string, " + ", ".join(f"{c} long" for c in COUNTS)
    counted = rows.join(F.broadcast(chosen.where(F.col("_fold") != CALIBRATION)), "_lid", "left").select("_text", "_label")
    words = _summed(counted.mapInArrow(_count_words, schema.format("word")), "word")
    grams = _summed(words.mapInArrow(_count_grams, schema.format("gram")), "gram")
    model = Model(*_divided(_ratios(grams), words))
    held = rows.join(F.broadcast(chosen.where(F.col("_fold") == CALIBRATION)), "_lid")
    model.calibrate(model.with_raw(held.select("_label", "_text")).select("_label", F.col("_raw").alias("x")).toArrow())  # at most 2 * SAMPLE rows of two numbers
    return model


def _divided(ratios: DataFrame, words: DataFrame) -> tuple[Entries, DataFrame | None]:
    """At most ENTRIES of the model's entries, for tasks to hold: the count under which they are left to a table doubles
    until the others fit. And that of words to which the table gives another value: word, _more (what it adds)."""
    ratios = staged(ratios, "toxicity-ratios")
    steps = [LEAST << i for i in range(61)]
    sizes = ratios.agg(*[F.count(F.when(F.col("n") >= x, 1)).alias(f"c{i}") for i, x in enumerate(steps)]).first()
    least = next(x for i, x in enumerate(steps) if sizes[i] <= ENTRIES)
    held = Entries(ratios.where(F.col("n") >= least).select("key", "own", "r").toArrow())
    if least == LEAST:
        return held, None
    rest = ratios.where(F.col("n") < least).select("key", "own", "r")
    context = words.sparkSession.sparkContext
    bits, sent = context.broadcast(_bits(rest, "key")), context.broadcast(held)
    asked = words.select("word").mapInArrow(lambda batches: _asked(bits.value, batches), "word string, key string")
    found = asked.join(rest, "key").groupBy("word").agg(F.collect_list(F.struct("key", "own", "r")).alias("found"))
    others = staged(found.mapInArrow(lambda batches: _valued(sent.value, batches), "word string, _more double"), "toxicity-others")
    return Entries(held.table, _bits(others, "word")), others


def _bits(rows: DataFrame, column: str) -> bytes:
    """FILTER bits, of which those at the hashes of a column's values are set."""
    place = F.xxhash64(column).bitwiseAND(F.lit(FILTER - 1))
    at = rows.select(F.shiftright(place, 6).alias("at"), (place % 64).cast("int").alias("bit")).select("at", F.expr("shiftleft(1L, bit)").alias("bit"))
    found = at.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER / 64 rows
    out = np.zeros(FILTER // 64, "<i8")
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def likely(bits: bytes, value: str) -> int:
    """Not 0 if value may be among those of the filter."""
    place = xxhash.xxh64_intdigest(value.encode(), 42) % FILTER  # as Spark's xxhash64
    return bits[place >> 3] >> (place & 7) & 1


def _asked(bits: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each word that may be in the filter's table: few, so that keys of many words crowd no task."""
    kept = _Kept(lambda key: likely(bits, key))
    for batch in batches:
        for at in range(0, batch.num_rows, 5_000):
            words, keys = [], []
            for w in batch.column("word").slice(at, 5_000).to_pylist():
                grams = {*head_grams(w[: BEFORE - 1]), *tail_grams(w)}
                some = [k for k in grams | {g[:-1] for g in grams} if kept[k]]
                words += [w] * len(some)
                keys += some
            yield pa.record_batch([pa.array(words, pa.string()), pa.array(keys, pa.string())], ["word", "key"])


def _valued(entries: Entries, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words whose value is another with the entries found for them."""
    entries.load()
    for batch in batches:
        words = batch.column("word").to_pylist()
        more = [entries.word_with(w, found) - entries.word(w) for w, found in zip(words, batch.column("found").to_pylist())]
        rows = [i for i, x in enumerate(more) if x]
        yield pa.record_batch([pa.array([words[i] for i in rows], pa.string()), pa.array([more[i] for i in rows], pa.float64())], ["word", "_more"])


def _ratios(grams: DataFrame) -> DataFrame:
    """key, own, r, n: log ratios of the classes' probabilities, of the grams that a class has seen (own)
    n times, and of what the classes leave to the shared model after each context they have seen."""
    g = grams.withColumn("_ctx", F.expr("substring(gram, 1, length(gram) - 1)")).withColumn("_tail", F.expr("substring(gram, 2)"))
    sums = [F.sum(c).alias(f"s_{c}") for c in ("n_all", "n_toxic", "n_plain")] + [F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}") for c in ("n_all", "n_toxic", "n_plain")]
    contexts = g.groupBy("_ctx").agg(*sums)
    tails = g.groupBy("_tail").agg(F.count("*").alias("c_tail")).withColumn("_low", F.expr("substring(_tail, 1, length(_tail) - 1)"))
    lows = tails.groupBy("_low").agg(F.sum("c_tail").alias("s_low"), F.count("*").alias("t_low"))
    seen = g.where(F.col("n_toxic") + F.col("n_plain") >= LEAST).join(contexts, "_ctx").join(tails, "_tail").join(lows, "_low")
    d = DISCOUNT
    low = (F.greatest(F.col("c_tail") - d, F.lit(0)) + d * F.col("t_low") / 256) / F.col("s_low")
    shared = (F.greatest(F.col("n_all") - d, F.lit(0)) + d * F.col("t_n_all") * low) / F.col("s_n_all")

    def own(c: str) -> Column:
        return F.log((F.greatest(F.col(c) - d, F.lit(0)) + (d * F.col(f"t_{c}") + MASS) * F.col("_shared")) / (F.col(f"s_{c}") + MASS))

    left = lambda c: F.log((d * F.col(f"t_{c}") + MASS) / (F.col(f"s_{c}") + MASS))
    rest = F.when(F.abs(left("n_toxic") - left("n_plain")) >= SLIGHT, left("n_toxic") - left("n_plain")).otherwise(0.0)
    own_ratio = (own("n_toxic") - own("n_plain")).cast("float")
    a = seen.withColumn("_shared", shared).select(F.col("gram").alias("key"), F.lit(True).alias("own"), own_ratio.alias("r"), rest.alias("rest"), (F.col("n_toxic") + F.col("n_plain")).alias("n")).where(F.abs(F.col("r") - F.col("rest")) >= SLIGHT).drop("rest")
    b = contexts.where(F.col("s_n_toxic") + F.col("s_n_plain") >= LEAST).select(F.col("_ctx").alias("key"), F.lit(False).alias("own"), (left("n_toxic") - left("n_plain")).cast("float").alias("r"), (F.col("s_n_toxic") + F.col("s_n_plain")).alias("n")).where(F.abs("r") >= SLIGHT)
    return a.unionByName(b)


class _Kept(dict):
    """Values of words, computed when first asked for."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word):
        if len(self) >= HELD_WORDS:
            self.clear()
        self[word] = x = self.value(word)
        return x


def _sum(grams: list[str], own: Mapping[str, float], contexts: Mapping[str, float]) -> float:
    x, get, rest = 0.0, own.get, contexts.get
    for g in grams:
        if (r := get(g)) is None:
            r = rest(g[:-1], 0.0)
        x += r
    return x


class Entries:
    """Log ratios by gram and by context, as tasks hold them, and a filter of the words that others give another value."""

    def __init__(self, table: pa.Table, bits: bytes | None = None):
        self.table, self.bits = table, bits
        self.grams, self.contexts, self.kept, self.heads, self.other = {}, {}, None, None, None

    def load(self) -> None:
        if self.kept is None:
            for mine, of in ((True, self.grams), (False, self.contexts)):
                part = self.table.filter(pc.equal(self.table.column("own"), mine))
                of.update(zip(part.column("key").to_pylist(), part.column("r").to_pylist()))
            self.table = None
            self.kept, self.heads = _Kept(self.word), _Kept(lambda head: _sum(head_grams(head), self.grams, self.contexts))
            self.other = _Kept(lambda word: likely(self.bits, word))

    def word(self, w: str) -> float:
        x = self.heads[w[: BEFORE - 1]] + _sum(tail_grams(w), self.grams, self.contexts)
        return x if x >= NEUTRAL else 0.0

    def word_with(self, w: str, found: list[dict]) -> float:
        """Its value with more entries."""
        own, contexts = (ChainMap({f["key"]: f["r"] for f in found if f["own"] == mine}, of) for mine, of in ((True, self.grams), (False, self.contexts)))
        x = _sum(head_grams(w[: BEFORE - 1]), own, contexts) + _sum(tail_grams(w), own, contexts)
        return x if x >= NEUTRAL else 0.0

    def raw(self, text: str) -> float:
        """Difference of the log-likelihoods by word, spread by a logarithm."""
        self.load()
        words = words_of(text)
        return math.log1p(1000 * math.fsum(map(self.kept.__getitem__, words)) / max(1, len(words)))

    def parts(self, text: str) -> tuple[float, int, list[str]]:
        """Sum and number of the words, and those that may have another value."""
        self.load()
        words = words_of(text)
        return math.fsum(map(self.kept.__getitem__, words)), len(words), [w for w in words if self.other[w]]


class Model:
    """Entries that tasks hold, the words to which all others give another value (None: no others), and the calibration of a text's raw score."""

    def __init__(self, entries: Entries, others: DataFrame | None):
        from pyspark.sql import SparkSession

        self.others, self.weights = others, (0.0, 1.0)
        self.sent = SparkSession.active().sparkContext.broadcast(entries)

    def raw(self, text: Column) -> Column:
        """The raw score of a text that isn't null, where tasks hold all entries."""
        sent = self.sent

        @F.pandas_udf("double")
        def raw(texts: pd.Series) -> pd.Series:
            return pd.Series(list(map(sent.value.raw, texts)), dtype="float64")

        return raw(text)

    def with_raw(self, rows: DataFrame) -> DataFrame:
        """rows with _raw, their _text's raw score, in its place."""
        if self.others is None:
            return rows.withColumn("_raw", self.raw(F.col("_text"))).drop("_text")
        sent = self.sent

        @F.pandas_udf("x double, n long, words array<string>")
        def parts(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(list(map(sent.value.parts, texts)), columns=["x", "n", "words"]).astype({"x": "float64", "n": "int64"})

        split = staged(rows.withColumn("_parts", parts("_text")).drop("_text").withColumn("_row", F.monotonically_increasing_id()), "toxicity-parts")
        words = split.select("_row", F.explode("_parts.words").alias("word"))
        more = words.join(self.others, "word").groupBy("_row").agg(F.sum(F.col("_more").cast("decimal(28,18)")).cast("double").alias("_more"))  # whatever the order
        total = F.col("_parts.x") + F.coalesce("_more", F.lit(0.0))
        raw = F.log1p(1000 * F.greatest(total, F.lit(0.0)) / F.greatest(F.col("_parts.n"), F.lit(1)))
        return split.join(more, "_row", "left").withColumn("_raw", raw).drop("_row", "_parts", "_more")

    def calibrate(self, held: pa.Table) -> None:
        """Logistic regression of the label on the raw score, by Newton's method with a small ridge."""
        x, y = held.column("x").to_numpy().astype(float), held.column("_label").to_numpy().astype(float)
        if not 0 < y.sum() < len(y):  # nothing to tell apart: the raw score's sign decides
            self.weights = (-1.0, 1.0)
            return
        a, w, ridge = np.column_stack([np.ones_like(x), x]), np.zeros(2), np.diag([1e-3, 1e-2])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w = w - np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (p - y) + ridge @ w)
        self.weights = (float(w[0]), float(w[1]))

    def score(self, raw: Column) -> Column:
        z = self.weights[0] + self.weights[1] * raw
        return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), z))))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id_col, held_out, score, predicted.

    Null and empty texts get the score of a text without words; a null id is in fold
    crc32(''), and null labels or ids of labels are left out. Of several labels of an id the
    largest counts. Without labels of both kinds, scores come from whatever counts there are.
    Repeated rows get equal scores each. Other columns of docs and labels are ignored.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    raw = model.with_raw(docs.select(F.col(id_col), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    return raw.select(id_col, "held_out", model.score(F.col("_raw")).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that the model predicts to be toxic."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    if model.others is None:
        return docs.where(model.score(model.raw(text)) < 0.5)
    digest = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    raw = model.with_raw(docs.select(digest[0].alias("_d1"), digest[1].alias("_d2"), text.alias("_text")))
    toxic = staged(raw.where(model.score(F.col("_raw")) >= 0.5).select("_d1", "_d2"), "toxic")
    return docs.join(toxic, (digest[0] == toxic["_d1"]) & (digest[1] == toxic["_d2"]), "left_anti")
