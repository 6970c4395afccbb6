from __future__ import annotations

import datetime as dt
import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom import registry
from threadloom.functions import parsers as P
from threadloom.functions import scalars as S
from threadloom.functions import text as X

NOW = dt.datetime(2024, 1, 31, tzinfo=dt.UTC)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("[PATCH v2 01/27] net: Add  thing", {"subject_norm_base": "net: add thing", "version_num": 2, "revision_inferred": False, "ordinal": 1, "total": 27, "has_patch_tag": True}),
        ("[RFC PATCH 0/5] cover", {"is_rfc": True, "ordinal": 0, "total": 5, "version_num": 1, "revision_inferred": True}),
        ("Re: [RESEND PATCH v3 2/3] x", {"had_reply_prefix": True, "is_resend": True, "version_num": 3}),
        ("[PATCHv4 6/5] x", {"version_num": 4, "ordinal": 6, "total": 6}),
        ("fwd: Re: plain", {"had_reply_prefix": True, "has_patch_tag": False, "subject_norm_base": "plain"}),
        ("[PATCH v0 1/1] x", {"version_num": 1, "revision_inferred": True}),
        ("[[PATCH] net-next, v7] y", {"has_patch_tag": True, "extra_tags": ["net-next"], "version_num": 7}),
        ("[[[rfc] PATCH] q v3] y", {"is_rfc": True, "extra_tags": ["q"], "version_num": 3, "subject_norm_base": "y"}),
        ("[a [b] c [d] e] x", {"extra_tags": ["a", "b"], "subject_norm_base": "c [d e] x"}),
        ("]] [[a]] b", {"extra_tags": [], "subject_norm_base": "]] [a] b"}),
        ("[[open", {"extra_tags": [], "subject_norm_base": "[[open"}),
        ("ab: [x] y", {"had_reply_prefix": True, "extra_tags": ["x"], "subject_norm_base": "y"}),
        ("ab: y", {"had_reply_prefix": False, "subject_norm_base": "ab: y"}),
        ("abcd: [x] y", {"had_reply_prefix": False, "subject_norm_base": "abcd: [x] y"}),
        ("", {"subject_norm_base": "", "counters_inferred": True}),
        (None, {"subject_norm_base": ""}),
    ],
)
def test_subjects(raw, want):
    found = P.parse_subject(raw)
    assert {k: getattr(found, k) for k in want} == want


DIFF = "diff --git a/old.c b/new.c\nrename from old.c\nrename to new.c\n--- a/old.c\n+++ b/new.c\n@@ -1,2 +1,2 @@\n-a\n+b\n c\n"


def test_diffs():
    kinds = lambda d: [(f["old_path"], f["new_path"], f["change_type"], f["additions"], f["deletions"]) for f in P.diff_files(d)]
    assert kinds(DIFF) == [("old.c", "new.c", "R", 1, 1)]
    two = "ü intro\n" + DIFF + "diff --git a/z b/z\ndeleted file mode 100644\n--- a/z\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    files = P.diff_files(two)
    assert [f["change_type"] for f in files] == ["R", "D"]
    assert all(two.encode()[f["diff_start"] :].startswith(b"diff --git ") for f in files)
    assert files[1]["diff_end"] == len(two.encode())
    assert kinds('diff --git "a/a b" "b/a b"\nBinary files differ\n') == [("a b", "a b", "B", 0, 0)]
    assert kinds("Index: x.c\n--- x.c\n+++ x.c\n@@ -1 +1 @@\n-a\n+b\n") == [("x.c", "x.c", "M", 1, 1)]
    assert kinds("diff --git a/n b/n\r\nnew file mode 100644\r\n--- /dev/null\r\n+++ b/n\r\n@@ -0,0 +1 @@\r\n+x\r\n++y\r\n") == [(None, "n", "A", 2, 0)]
    assert kinds("new file mode 100644\n--- a/n\n+++ b/n\n") == [("n", "n", "M", 0, 0)]
    assert P.diff_files("") == [] and P.diff_files(None) == []
    # A removed line that begins with "-- " reads as a path marker.
    assert kinds("diff --git a/q b/q\n--- a/q\n+++ b/q\n@@ -1 +1 @@\n--- y\n+z\n")[0][0] == "y"


def test_patch_ids():
    assert P.patch_id(DIFF) == P.patch_id(DIFF.replace("\n", "\r\n")) == P.patch_id(DIFF.replace("-1,2", "-9,2"))
    assert P.patch_id(DIFF) != P.patch_id(DIFF.replace("+b", "+d"))
    assert P.patch_id("") is None and P.patch_id(None) is None and P.patch_id("nothing") is None


MAIL = b"From: =?utf-8?q?J=C3=B6?= <J@Example.org>\r\nTo: list@x\r\nMessage-ID: <A@b>\r\nReferences: <r1@x> <r1@x> <r2@x>\r\nDate: Mon, 1 Jan 2024 10:00:00 +0100\r\nSubject: Re: [PATCH] Fix\x00  it\r\n\r\nHello  \r\n---\r\n" + DIFF.encode()


def test_mail():
    m = P.parse_mail(MAIL, NOW)
    assert (m["error"], m["from_name"], m["from_email"], m["subject_norm"]) == (None, "Jö", "j@example.org", "fix it")
    assert m["references_ids"] == ["r1@x", "r2@x"] and m["date_utc"] == dt.datetime(2024, 1, 1, 9, tzinfo=dt.UTC)
    assert m["has_diff"] and m["search_text"].startswith("Hello") and "diff" not in m["search_text"]
    same = P.parse_mail(MAIL.replace(b"Hello  \r\n", b"Hello\n"), NOW)
    assert same["content_hash"] == m["content_hash"]
    for old, new, why in ((b"Mon, 1 Jan 2024 10:00:00 +0100", b"Mon, 1 Jan 2034 10:00:00 +0100", "future_date"), (b"Date: Mon, 1 Jan 2024 10:00:00 +0100\r\n", b"", "missing_date"), (b"Mon, 1 Jan 2024 10:00:00 +0100", b"soon", "invalid_date"), (b"<A@b>", b"none", "missing_message_id"), (b"<J@Example.org>", b"", "missing_author_email")):
        assert P.parse_mail(MAIL.replace(old, new), NOW) == {"error": why}
    assert P.parse_mail(None, NOW)["error"]


def test_mail_parts():
    raw = b'From: a@x\nMessage-ID: <i@x>\nDate: Mon, 1 Jan 2024 10:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="B"\n\n--B\nContent-Type: text/plain\n\nwords\n--B\nContent-Type: text/x-patch\nContent-Disposition: attachment; filename="f.patch"\n\n' + DIFF.encode() + b"\n--B--\n"
    m = P.parse_mail(raw, NOW)
    assert m["has_attachments"] and m["subject_raw"] == "(No Subject)" and m["diff_text"].startswith("diff --git")
    assert m["body_text"].startswith("diff --git"), "a later part with a diff is preferred"


def test_columns(spark):
    df = spark.createDataFrame([(" Re: [X] fw:  A  b ", "<A@b> <a@B>, c", "abcdef", "x\r\n> q\r\ny \r\n")], "s string, ids string, t string, q string")
    row = df.select(X.normalize_subject(F.col("s")), X.dedupe_in_order(X.message_ids(F.col("ids"))), X.snippet(F.col("t"), 3), X.strip_quoted_lines(F.col("q")), X.text_for_hash(F.col("q")), S.tag_parts(F.lit("v5.10-rc3"))["tag_sort_key"], S.tag_parts(F.lit("next"))).first()
    assert row[0] == "a b" and row[1] == ["a@b"] and row[2] == "abc..." and row[3] == "x\ny" and row[4] == "x\n> q\ny" and row[5] == 5_010_000_003 and row[6] is None


def test_parameters():
    assert S.window_days(None) == 30 and S.window_days("7d") == 7 and S.clamp_limit(None, 50, 200) == 50 and S.clamp_limit(900, 50, 200) == 200
    with pytest.raises(ValueError):
        S.window_days("0d")
    assert S.timestamp("2024-01-02") == dt.datetime(2024, 1, 2, tzinfo=dt.UTC) and S.timestamp(" ") is None


def test_long_prose_is_whole(spark, tmp_path):
    text = "word " * 20_000 + "end"
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = registry.queries()["diffs_in_text"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["prose_md5"] for r in rows] == [hashlib.md5(t.encode()).hexdigest() for t in (text, "")]
    assert spark.range(1).select(F.length(X.search_text(F.lit(text)))).first()[0] == 80_000


def test_tags_are_read_once_a_head(monkeypatch):
    seen, read = [], P._read_tag
    monkeypatch.setattr(P, "_read_tag", lambda out, tag: (seen.append(tag), read(out, tag)))
    found = [P.parse_subject(f"{'Re: ' * (i % 2)}[once-only v4 {i % 2}/7] part {i}") for i in range(10)]
    assert len(seen) == 6 and [(s.subject_norm_base, s.had_reply_prefix, s.version_num, s.ordinal, s.extra_tags) for s in found] == [(f"part {i}", i % 2 == 1, 4, i % 2, ["once-only"]) for i in range(10)]
    assert len({id(s.extra_tags) for s in found}) == 10


def test_headers_and_names_are_read_once():
    diff = "text ä\ndiff --git a/drivers/once.c b/drivers/once.c\n--- a/drivers/once.c\n+++ b/drivers/once.c\n@@ -1 +1 @@\n-é\n+x\ndiff --git a/z b/z\nBinary files a/z and b/z differ\n"
    first = P.diff_files(diff)
    had = P._sides.cache_info().misses, P._marked.cache_info().misses
    assert P.diff_files(diff) == first and (P._sides.cache_info().misses, P._marked.cache_info().misses) == had
    assert [(f["new_path"], f["change_type"], f["additions"], f["diff_start"], f["diff_end"]) for f in first] == [("drivers/once.c", "M", 1, 8, 8 + 106), ("z", "B", 0, 8 + 106, len(diff.encode()))]
    column = P._diff_files(pa.array([diff, None, "", "no diff"]))
    assert column.to_pylist() == [first, [], [], []] and column.type == P._FILES_ARROW
