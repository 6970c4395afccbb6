from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadloom.functions.scalars import timestamp, window_days
from threadloom.operators.records import advanced, replace_canonical, thread_refs
from threadloom.operators.search import cropped, filtered, patch_item_documents
from threadloom.sources.repos import COMMITS, discover, hash_embedder
from threadloom.streaming.incremental import DOCUMENTS, VECTORS, Store, current, ingest_batch


def test_discover(spark, tmp_path):
    for folder in ("epochs/git/10.git", "epochs/git/9.git", "epochs/all.git", "whole/all.git", "bare/objects", "none/x"):
        (tmp_path / folder).mkdir(parents=True)
    found = [(r["list_key"], r["repo_relpath"]) for r in discover(spark, str(tmp_path)).collect()]
    assert found == [("bare", "."), ("epochs", "git/9.git"), ("epochs", "git/10.git"), ("whole", "all.git")]


def test_crops(spark):
    texts = [(0, None), (1, " \n"), (2, "one two three"), (3, "a b c d e (Hit), f g h i"), (4, "hit b c d e f"), (5, "a b c d e f hit")]
    got = {r["id"]: r["c"] for r in spark.createDataFrame(texts, "id int, text string").select("id", cropped(F.col("text"), "HIT", 4).alias("c")).collect()}
    assert got == {0: "", 1: "", 2: "one two three", 3: "...d e <em>(Hit),</em> f...", 4: "<em>hit</em> b c d...", 5: "...d e f <em>hit</em>"}
    assert spark.createDataFrame(texts, "id int, text string").select(cropped(F.col("text"), " ", 2).alias("c")).collect()[2]["c"] == "one two..."


def test_records_without_rows(spark):
    marks = spark.createDataFrame([(1, "r", 5)], "list_id long, repo_key string, at long")
    assert advanced(marks, marks.limit(0)).collect() == marks.collect()
    assert [tuple(r) for r in advanced(marks.limit(0), marks, reset=marks).collect()] == [(1, "r", None)]
    matches = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True)], "item_id long, commit_oid string, is_canonical boolean")
    assert replace_canonical(matches, matches.limit(0).drop("is_canonical")).count() == 3
    new = matches.where("item_id = 1 and commit_oid = 'b'").drop("is_canonical")
    assert {tuple(r) for r in replace_canonical(matches, new).collect()} == {(1, "a", False), (1, "b", True), (2, "a", True)}
    versions = spark.createDataFrame([(1, None, None), (2, 7, 8)], "version_id long, cover_message_pk long, first_patch_message_pk long")
    instances = spark.createDataFrame([], "list_id long, message_pk long, seen_at timestamp")
    members = spark.createDataFrame([], "list_id long, message_pk long, thread_id long")
    assert [tuple(r) for r in thread_refs(versions, instances, members, 1).collect()] == [(1, None, None, "no_anchor")]


def test_merged_filter_waits(spark):
    docs = spark.createDataFrame([("series-1", "merged"), ("series-2", "partial")], "doc_id string, merge_state string")
    with pytest.raises(RuntimeError):
        filtered(docs, "series", merged=True, ready=False)
    with pytest.raises(ValueError):
        filtered(docs, "thread", merged=True)
    assert [filtered(docs, "series", merged=m).collect()[0]["doc_id"] for m in (True, False)] == ["series-1", "series-2"]


def test_parameters():
    assert timestamp(" ") is None and timestamp("2024-01-02") == dt.datetime(2024, 1, 2, tzinfo=dt.UTC)
    assert timestamp("2024-01-02T03:00:00+01:00") == dt.datetime(2024, 1, 2, 2, tzinfo=dt.UTC)
    assert window_days(None) == 30 and window_days("7d") == 7


def mail(n: int, above: int | None = None) -> tuple:
    reply = f"\nReferences: <{above}@x>" if above is not None else ""
    raw = f"From: A <a@x>\nMessage-ID: <{n}@x>\nDate: Mon, 01 Jan 2024 00:0{n}:00 +0000\nSubject: s{n}{reply}\n\ntext {n}\n"
    return (1, "git/0.git", f"c{n}", [], dt.datetime(2024, 1, 1), "", "", raw.encode())


def test_stream_documents(spark, tmp_path):
    """A message that joins two threads leaves one document; a replay of a batch changes nothing."""
    store, now = Store(spark, f"file://{tmp_path}/store"), dt.datetime(2024, 1, 31, tzinfo=dt.UTC)
    batches = [[mail(1), mail(3, 2), mail(4)], [mail(2, 1)]]
    seen = []
    for batch in (0, 1, 1):
        ingest_batch(store, spark.createDataFrame(batches[batch], COMMITS), batch, now, (hash_embedder(4), 4))
        docs = {r["doc_id"]: (r["message_count"], r["batch"]) for r in current(store, "documents", DOCUMENTS).collect()}
        assert current(store, "vectors", VECTORS).where(F.col("doc_id").isin(list(docs))).count() == len(docs)
        seen.append(docs)
    assert seen[0] == {"thread-1-1@x": (1, 0), "thread-1-2@x": (1, 0), "thread-1-4@x": (1, 0)}
    assert seen[1] == seen[2] == {"thread-1-1@x": (3, 1), "thread-1-4@x": (1, 0)}


def test_texts_of_items_move_once(spark):
    items = spark.createDataFrame([(1, 10, 100, 1, "s", None, True), (2, 10, 101, 2, "t", "c", False)], "item_id long, version_id long, message_pk long, ordinal int, subject string, commit_subject string, has_diff boolean")
    versions = spark.createDataFrame([(10, 7, 1, False, dt.datetime(2024, 1, 2))], "version_id long, series_id long, version_num int, is_rfc boolean, sent_at timestamp")
    messages = spark.createDataFrame([(100, "a@x", "+" * 70_000), (101, "b@x", None), (102, "c@x", "unused")], "message_pk long, message_id_primary string, diff_text string")
    files = spark.createDataFrame([(1, "g"), (1, "f"), (1, "g")], "item_id long, new_path string")
    docs = patch_item_documents(items, versions, spark.createDataFrame([(7, "a")], "series_id long, author_email string"), messages, files, spark.createDataFrame([(7, "l")], "series_id long, list_key string"))
    got = sorted((r["id"], len(r["diff_search"]), r["file_paths"], r["list_keys"], r["message_id_primary"]) for r in docs.collect())
    assert got == [(1, 60_000, ["f", "g"], ["l"], "a@x"), (2, 0, [], ["l"], "b@x")]
    lines = docs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "AS diff_search" in line)
    above, last = [], depth(lines[at])
    for line in lines[:at][::-1]:
        if depth(line) < last:
            above, last = [*above, line], depth(line)
    assert sum("Join" in line for line in above) == 1
