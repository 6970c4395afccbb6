"""The positional index and its dictionary against plain searches."""

from __future__ import annotations

import random
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from threadloom.operators import postings
from threadloom.operators.postings import Index, build_index, query_words, search_index

FIELDS = "doc_id string, list_keys array<string>, subject string, author_emails array<string>, participants_joined string, has_diff boolean, snippet_corpus string, date_ts long"


def doc(i, subject, people, text):
    return (f"d{i:02}", ["l"], subject, ["a@x"], people, i % 2 == 0, text, i)


TEXTS = ["fix memory leak in driver", "Memory: leak!", "leak of memory", "driver leak memory leak", "memroy leak", None, "", "fix a leak in the great big memory", "memory leaks", "naïve mémory", "memory " * 50 + "leak", "unrelated"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [doc(i, t, "ann", "memory here, leak there") if i % 4 == 3 else doc(i, "subject", None, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, FIELDS).repartition(2)


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    return build_index(docs, "thread", f"file://{tmp_path_factory.mktemp('index')}", buckets=8)


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def may(word: str) -> int:
    return 0 if len(word) < 5 or len(word) > 40 else 1 if len(word) < 9 else 2


def plain_rules(rows: list[tuple], query: str) -> dict[str, tuple]:
    asked = query_words(query)
    out = {}
    for d in rows:
        fields = [query_words_all(x) for x in (d[2], d[4], d[6])]
        hit = lambda w, t: w == t or 0 < may(w) >= edits(w, t) and 4 <= len(t) <= 42
        at = [[[(p, edits(w, t)) for p, t in enumerate(f) if hit(w, t)] for f in fields] for w in asked]
        found = [i for i in range(len(asked)) if any(at[i])]
        if not found:
            continue
        typos = [min(e for f in at[i] for _, e in f) for i in found]
        near = [min([8, *(max(1, q - p) if q >= p else p - q + 1 for f, g in zip(a, b) for p, _ in f for q, _ in g)]) for a, b in zip(at, at[1:])]
        field = [min(n for n, f in enumerate(at[i]) if f) for i in found]
        out[d[0]] = (len(found), sum(typos), sum(near), sum(field), typos.count(0) + any(f == asked for f in fields))
    return out


def query_words_all(text: str | None) -> list[str]:
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return "".join(c if c.isalnum() or c == "_" else " " for c in low).split()


@pytest.mark.parametrize("query", ["memory leak", "leak memory", "memory", "memori leak driver", "mémory", "nothing", "a", "leak leak", ""])
def test_ranked(docs, index, query):
    got = {r["doc_id"]: tuple(r)[1:] for r in index.ranked(query).collect()}
    assert got == plain_rules([tuple(r) for r in docs.collect()], query)


def test_order_and_filters(docs, index):
    page = [r["doc_id"] for r in search_index(index, docs, "thread", "memory leak", limit=50).collect()]
    rules = plain_rules([tuple(r) for r in docs.collect()], "memory leak")
    assert page == sorted(rules, key=lambda d: (-rules[d][0], rules[d][1], rules[d][2], rules[d][3], -rules[d][4], d))
    some = search_index(index, docs, "thread", "memory leak", has_diff=True, limit=2, offset=1).collect()
    assert [r["doc_id"] for r in some] == [d for d in page if int(d[1:]) % 2 == 0][1:3]
    newest = [r["doc_id"] for r in search_index(index, docs, "thread", "leak", sort="date_desc", limit=2).collect()]
    assert newest == sorted(plain_rules([tuple(r) for r in docs.collect()], "leak"))[::-1][:2]


def test_only_postings_of_the_words_are_read(index):
    plan = index.matches(["memory"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: [In(term, " in plan


def test_corrections(spark, index, monkeypatch):
    rng = random.Random(2)
    terms = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(3, 11))) for _ in range(400)} | {"x" * 60, "x" * 61, "y" * 42, "y" * 40})
    words = spark.createDataFrame([(w,) for w in [*terms[::9], "zzzzz", "x" * 60, "y" * 40, ""]], "word string")
    own = Index(spark, f"{index.path}/own", buckets=4)
    rows = [("d", 0, 1, i, t) for i, t in enumerate(terms)]
    monkeypatch.setattr(postings, "tokens", lambda docs, fields: spark.createDataFrame(rows, "doc_id string, field int, n int, place int, term string"))
    own.build(words, ())
    got = sorted(map(tuple, own.corrected(words).collect()))
    want = [(w, t, edits(w, t)) for (w,) in words.collect() for t in {*terms, w} if t == w or 0 < may(w) >= edits(w, t)]
    assert got == sorted(want) and len(want) > 100


def test_many_words_are_joined(docs, index, monkeypatch):
    monkeypatch.setattr(postings, "NAMED", 1)
    got = {r["doc_id"]: tuple(r)[1:] for r in index.ranked("memory leak").collect()}
    assert got == plain_rules([tuple(r) for r in docs.collect()], "memory leak")


def test_words_are_split_once(spark, tmp_path, monkeypatch):
    split = spark.sparkContext.accumulator(0)
    once = F.udf(lambda t: split.add(1) or t, "string").asNondeterministic()
    rows = [(f"d{i}", 0, 3, p, f"word{p}{i % 7}") for i in range(40) for p in range(3)]
    monkeypatch.setattr(postings, "tokens", lambda docs, fields: spark.createDataFrame(rows, "doc_id string, field int, n int, place int, term string").withColumn("term", once("term")))
    index = Index(spark, f"file://{tmp_path}/once", buckets=1).build(spark.createDataFrame([("d",)], "doc_id string"), ())
    assert split.value == len(rows) == index.postings().count()


def test_tables_are_compressed_well(index):
    for table in ("postings", "typos"):
        files = list(Path(index.path.removeprefix("file://"), table).rglob("*.parquet"))
        groups = [pq.ParquetFile(f).metadata.row_group(0) for f in files]
        assert groups and {g.column(c).compression for g in groups for c in range(g.num_columns)} == {"ZSTD"}
