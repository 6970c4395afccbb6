"""Manifests against trees built by hand, with awkward rows and on every path to the root."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from threadloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, pos int, leaf string, root string, row string"


def documents(n: int = 700) -> list[tuple]:
    rows = [(i * 7 % 1009, f"Text {i} É", ["en", "de", None, "", "=x"][0 if i % 3 else i % 5], f"s{i % 4}" if i % 6 else None, i if i % 11 else None, "g", 1, "l", "r", "w") for i in range(n)]
    odd = [(None, None, "en", None, None), (None, "Loose", "en", "s", 1), (5000, "", "en", "", 0), (5001, "Long " * 200_000, "alone", "s", 3), (5002, None, None, "s", 4)]
    return rows + [(*o, None, None, None, None, None) for o in odd] + [rows[3], rows[3], rows[4]]


def tree(hashes: list[str]) -> tuple[str, list[list[list[str]]]]:
    """The root, and of each leaf the runs that it is in with its place in each."""
    steps = [[] for _ in hashes]
    level, owner = hashes, list(range(len(hashes)))
    while len(level) > 1:
        for leaf, at in enumerate(owner):
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            steps[leaf].append((at % 8, run))
        level = [hashlib.sha256("".join(level[i : i + 8]).encode()).hexdigest() for i in range(0, len(level), 8)]
        owner = [at // 8 for at in owner]
    return level[0], steps


def expected(rows: list[tuple]) -> list[tuple]:
    def leaf(doc_id, text, lang, source, n_chars):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is None, r[0], leaf(*r[:5]), r))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in order:
        langs[lang].sort(key=lambda x: (x[0], x[1] or 0, x[2]))
        trees.append(tree([x[2] for x in langs[lang]]))
    root, over = tree([t[0] for t in trees])
    out = []
    for lang, (subroot, steps), above in zip(order, trees, over):
        for (_, doc_id, h, r), own in zip(langs[lang], steps):
            path = own + above
            text = r[1]
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(r[0], text, *r[2:5])
            for at, run in path:
                fold = hashlib.sha256("".join([*run[:at], fold, *run[at + 1 :]]).encode()).hexdigest()
            proof = hashlib.sha256("".join(x for at, run in path for i, x in enumerate(run) if i != at).encode()).hexdigest()
            out.append((doc_id, h, subroot, root, proof, fold, fold == root))
    return out


@pytest.mark.parametrize(("levels", "top"), [(4, 4096), (1, 4096), (1, 40), (2, 3)])
def test_document_proofs(spark, monkeypatch, levels, top):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "TOP", top)
    rows = documents()
    got = merkle.document_proofs(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = got.collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected(rows)))
    assert {r["verified"] for r in found} == {True, False}


def test_sizes(spark):
    for n in (0, 1, 8, 9, 64, 65):
        rows = [(i, f"T{i}", "en", "s", 1, "g", 1, "l", "r", "w") for i in range(n)]
        got = merkle.document_proofs(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(rows) if rows else []))


def test_proofs_of_any_rows(spark):
    rows = spark.createDataFrame([(i, hashlib.sha256(bytes([i])).hexdigest(), "own") for i in range(20)], "k int, leaf string, path string")
    out = merkle.proofs(rows.withColumn("of", F.col("k") % 2), "of", "k")
    assert out.columns == ["k", "leaf", "of", "subroot", "root", "path"] and out.count() == 20
    assert out.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert out.where(merkle.folded(F.lit("0" * 64), F.col("path")) == F.col("root")).isEmpty()
