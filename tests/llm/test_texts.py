"""Operators on texts against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom.llm import bpe, mixing, near_texts, substrings, suffix_levels, token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k string, _text string, size int, _row string"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def awkward() -> list[tuple]:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, base = prose(60), prose(200)
    near = base.split(" ")
    near[100] = "changed"
    texts = [None, "", " \t\n", prose(20), base, base, " ".join(near), prose(70) + " " + passage, passage + "\n" + prose(30), prose(10) + passage[5:], "la " * 300, "x" * 5000, prose(20_000), "ü" * 900, passage, passage, "a b c", "a b c d"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "own", "own", 1, "own") for i, t in enumerate(texts)]
    return rows + [rows[4], rows[9], (None, base, None, None, None, None, None, None, None), (None, None, None, "s1", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_passages(spark, docs):
    def expected(n):
        first, order = {}, lambda i: 1 << 63 if i is None else i
        for i, t, *_ in awkward():
            w = WORDS.findall(t or "")
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                first[k] = min(order(i), first.get(k, 1 << 63))
        for i, t, *_ in awkward():
            w = WORDS.findall(t or "")
            gone = {j for s in range(len(w) - n + 1) if first[tuple(w[s : s + n])] < order(i) for j in range(s, s + n)}
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            yield i, len(w), len(gone), sha(kept)

    for n in (50, 4):
        assert multiset(substrings.passage_digests(docs, window=n).collect()) == multiset(expected(n))
    assert substrings.passage_digests(empty(spark)).count() == 0
    kept = substrings.without_passages(docs)
    assert kept.columns == docs.columns and {r["_k"] for r in kept.collect()} <= {"own", None}
    have = {r["doc_id"]: r["text"] for r in kept.where("doc_id is not null").collect()}
    assert 5 not in have and 15 not in have and have[4] == awkward()[4][1] and have[0] is None
    assert substrings.without_passages(empty(spark)).count() == 0


def test_automaton(spark, docs):
    passage = awkward()[14][1].split(" ")
    a = substrings.Automaton()
    for s in (["a", "b", "a", "b", "c"], ["b", "a", "b", "c", "d"]):
        a.add(s)
    assert list(a.statistics("x a b c d a b a b d".split())) == [0, 1, 2, 3, 4, 1, 2, 3, 4, 1]
    rng = random.Random(1)
    seqs = [[rng.choice("abc") for _ in range(30)] for _ in range(4)]
    a = substrings.Automaton()
    for s in seqs:
        a.add(s)
    subs = {tuple(s[i:j]) for s in seqs for i in range(31) for j in range(i + 1, 31)}
    text = [rng.choice("abc") for _ in range(200)]
    assert list(a.statistics(text)) == [max((n for n in range(1, e + 2) if tuple(text[e + 1 - n : e + 1]) in subs), default=0) for e in range(200)]
    reference = spark.createDataFrame([(" ".join(passage),), (None,)], "text string")
    out = {r["doc_id"]: r for r in substrings.remove_reference(docs.where("doc_id is not null"), reference).collect()}
    assert out[14]["n_removed"] == 60 and out[14]["text"] == "" and out[7]["n_removed"] == 60 and out[3]["n_removed"] == 0
    with pytest.raises(ValueError, match="words"):
        substrings.REFERENCE_WORDS, limit = 10, substrings.REFERENCE_WORDS
        try:
            substrings.remove_reference(docs, reference)
        finally:
            substrings.REFERENCE_WORDS = limit


def test_repeats(spark, docs):
    texts = [(t or "").encode() for _, t, *_ in awkward()]
    for n in (400, 128):
        count: dict[bytes, int] = {}
        for b in texts:
            for s in range(len(b) - n + 1):
                count[b[s : s + n]] = count.get(b[s : s + n], 0) + 1
        want = []
        for (i, *_), b in zip(awkward(), texts):
            gone = bytearray(len(b))
            for s in range(len(b) - n + 1):
                if count[b[s : s + n]] > 1:
                    gone[s : s + n] = b"\1" * n
            kept = bytes(x for x, g in zip(b, gone) if not g)
            want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
        assert multiset(suffix_levels.repeat_digests(docs, length=n).collect()) == multiset(want)
    assert suffix_levels.repeat_digests(empty(spark)).count() == 0


def test_levels_merge(spark, docs):
    """Batches that come one by one make few levels, each in the order of its keys; merged ones are gone."""
    family = suffix_levels.Levels(spark, 128)
    for part in (7, 8, 9, 14):
        family.add_batch(suffix_levels.keyed(docs.where(F.col("doc_id") == part), "doc_id", "text"))
    whole = suffix_levels.Levels(spark, 128)
    whole.add_batch(suffix_levels.keyed(docs.where("doc_id in (7, 8, 9, 14)").dropDuplicates(["text"]), "doc_id", "text"))
    assert len(family.levels) <= 3 and sum(n for n, _ in family.levels) == family.suffixes().count()
    assert family.suffixes().select("_anchor").distinct().count() == whole.suffixes().select("_anchor").distinct().count() > 0
    files = family.suffixes().select("_anchor", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    by_file = {}
    for r in sorted(files, key=lambda r: r["i"]):
        by_file.setdefault(r["f"], []).append(r["_anchor"])
    assert all(keys == sorted(keys) for keys in by_file.values())


def test_repeats_across_batches(spark, docs):
    """What stands once in each of two batches repeats, and so do copies of a whole text, whichever way rows are dealt."""
    rng = random.Random(8)
    line = "".join(rng.choice("abcdefgh ") for _ in range(400))
    other = lambda n: "".join(rng.choice("ijklmnop ") for _ in range(n))
    rows = [(1, other(300) + line), (2, other(900)), (3, line + other(200)), (4, other(50) + line + other(50)), (5, other(700))]
    rows += [(6, rows[1][1]), (None, rows[4][1]), (7, other(500)), (8, rows[1][1][:450] + other(100))]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in suffix_levels.batch_digests([few.where(w) for w in ("doc_id in (1, 2)", "doc_id in (3, 5, 7)", "doc_id in (4, 6, 8) or doc_id is null")]).collect()}
    assert got == {1: 400, 2: 900, 3: 400, 4: 400, 5: 700, 6: 900, None: 700, 7: 0, 8: 450}
    parts = [docs.where(F.coalesce(F.pmod("doc_id", F.lit(3)), F.lit(0)) == i) for i in range(3)]
    assert multiset(suffix_levels.batch_digests(parts, length=128).collect()) == multiset(suffix_levels.repeat_digests(docs, length=128).collect())


def test_token_counts(spark, docs, tmp_path):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t, *_ in awkward()]
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):  # the second time all counts come from the cache
        assert multiset(token_counts.count_tokens(docs, cache_path=cache).collect()) == multiset(want)
    held = spark.read.parquet(cache)
    assert held.select("content").distinct().count() == len({t or "" for _, t, *_ in awkward()})
    assert held.count() <= len(awkward()) - 3, "of copies only one is encoded, unless they are repeated rows"
    token_counts.count_tokens(docs, cache_path=cache, tokenizer="word_bpe_49k.json").collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_bpe(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    rows = [(i, t) for i, t, *_ in awkward()] + [(100, "A <|endoftext|> b'LL ΣΑΣ ﬁń 你好 😀 12½"), (101, "wordwithoutend" * 400)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t in rows if i is not None}
    for r in bpe.bpe_digests(more).where("doc_id is not null").collect():
        e = ids[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(e), sha(" ".join(map(str, e))), sha(lib.decode(e, skip_special_tokens=False)))
    encoded = bpe.bpe_encode(more)
    assert {r["doc_id"]: r["ids"] for r in encoded.where("doc_id is not null").collect()} == ids
    back = {r["doc_id"]: r["text"] for r in bpe.bpe_decode(encoded).where("doc_id is not null").collect()}
    assert back[16] == "a b c " and back[1] == "" and back[101] == "wordwithoutend" * 400 + " " and "你好 " in back[100]
    assert bpe.bpe_digests(empty(spark)).count() == 0


def test_near_copies(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["kept"]) for r in near_texts.near_copies(docs).where("doc_id is not null").collect()}
    words = {i: WORDS.findall(t or "") for i, t, *_ in awkward() if i is not None}
    want = {i: i for i in words}
    for i in words:
        for j in range(i):
            if near_texts.similar(words[i], words[j]) and want[i] != want[j]:
                one, other = sorted((want[i], want[j]))
                want = {k: one if c == other else c for k, c in want.items()}
    assert want[1] == want[2] == 0 and want[5] == want[6] == 4 and want[15] == want[14] and want[17] == 17
    assert got == {i: (c, i == c) for i, c in want.items()}
    assert near_texts.near_copies(docs).count() == len(awkward())
    kept = near_texts.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    assert near_texts.near_copies(empty(spark)).count() == 0 and near_texts.without_near_copies(empty(spark)).count() == 0


def test_near_chain(spark):
    """Texts that are alike step by step are one group, though its ends are not alike."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(12):
        words = words[:]
        words[8 * i] = f"new{i}"
        rows.append((100 - i, " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in near_texts.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {89}


@pytest.mark.parametrize("block", [384, 7])
def test_near_crowds(spark, block, monkeypatch):
    """Texts around one origin, many of them just not alike: groups equal those of all pairs."""
    monkeypatch.setattr(near_texts, "BLOCK", block)
    rng = random.Random(12)
    origins = [[rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(40)) for _ in range(80)] for _ in range(2)]
    rows = []
    for i in range(120):
        words = list(origins[i % 2])
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(len(words))] = f"own{rng.randrange(30)}"
        rows.append((i, " ".join(words[: 80 - 6 * (i % 5)])))
    words = [t.split() for _, t in rows]
    want = {i: i for i, _ in rows}
    links = [(i, j) for i in want for j in want if i < j and near_texts.similar(words[i], words[j])]
    while any(want[i] != want[j] for i, j in links):
        for i, j in links:
            want[i] = want[j] = min(want[i], want[j])
    got = {r["doc_id"]: r["class_id"] for r in near_texts.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 10


def test_near_copies_share_ids(spark):
    """Different texts without an id, or with the same one, are each compared with all others, and none is lost."""
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"]
    near = lambda t: t.replace("30 ", "new ", 1)
    a, b, c, d, e, f, g = texts
    rows = [(None, a), (None, b), (None, near(b)), (None, c), (7, d), (7, e), (7, f), (8, near(e)), (9, near(c)), (10, near(f)), (11, g), (7, near(d))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_texts.near_copies(docs.repartition(3))
    want = [None, None, None, 9, 7, 7, 7, 7, 9, 7, 11, 7]
    assert sorted(map(repr, ((r["doc_id"], r["class_id"]) for r in got.collect()))) == sorted(repr((i, k)) for (i, _), k in zip(rows, want))
    kept = [(r["doc_id"], r["text"]) for r in near_texts.without_near_copies(docs.repartition(3)).collect()]
    assert len(kept) == 7 and set(kept) <= set(rows)
    for one in [(None, a), (9, near(c)), (7, e), (7, f), (11, g)]:
        assert one in kept
    for some in ({(None, b), (None, near(b))}, {(7, d), (7, near(d))}):
        assert len(some & set(kept)) == 1


def test_alignment():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(400):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(2))
        d = distance(a, b)
        assert [near_texts.edits_within(a, b, k) for k in range(26)] == [d <= k for k in range(26)]


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(awkward())
    sizes: dict = {}
    for _, t, _, s, *_ in awkward():
        sizes[s] = sizes.get(s, 0) + len(WORDS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], weight[s] * level) for s in order) < 1.5 * sum(sizes.values()) else (low, level)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - min(2 * sizes[r["source"]], weight[r["source"]] * level)) < 1e-3
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert multiset(rows) == multiset(mixing.mix_sources(docs.repartition(5)).collect())
    assert mixing.mix_sources(empty(spark)).count() == 0
    taken = sum(r["times"] for r in rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == taken


def test_mixing_repeated_rows(spark):
    """Where the cut falls among equal rows, the mix has as many rows as the plan says."""
    rows = [(5, "a b c", "x")] * 40 + [(6, "d e", "x")] * 7 + [(None, "f g", None)] * 9 + [(None, None, "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want: dict = {}
    for r in mixing.mix_sources(docs).collect():
        want[r["doc_id"], r["size"]] = want.get((r["doc_id"], r["size"]), 0) + r["times"]
    got: dict = {}
    for r in mixing.mixed(docs).collect():
        k = (r["doc_id"], len((r["text"] or "").split()))
        got[k] = got.get(k, 0) + 1
    assert got == {k: n for k, n in want.items() if n}


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(1, 40), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 40 for r in found)
