"""Scalar text functions as Column expressions: they stay in the JVM and in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARK = r"(?mi)^(---.*\n\+\+\+|GIT binary patch|diff --git \w/\S+ \w/\S+)"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends (trim() knows spaces only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def normalize_line_endings(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def sanitize_text(c: Column) -> Column:
    return strip(F.regexp_replace(normalize_line_endings(c), r"[\p{Cc}&&[^\n\t]]", ""))


def sanitize_email(c: Column) -> Column:
    bare = sanitize_text(c)
    for mark in ("<", ">", '"'):
        bare = F.regexp_replace(bare, rf"\A{mark}+|{mark}+\z", "")
    return ascii_lower(bare)


def normalize_subject(c: Column) -> Column:
    """Lower case, without reply prefixes and leading [tags], white space collapsed."""
    return collapse(F.regexp_replace(ascii_lower(sanitize_text(c)), r"(?U)\A(?:(?:re|fwd|fw|aw):\s*|\[[^\]]*\]\s*)+", ""))


def is_reply_subject(c: Column) -> Column:
    return ascii_lower(strip(c)).rlike(r"\A(re|aw|fwd|fw):")


def bare_id(c: Column) -> Column:
    """An id token without quotes and brackets around it, in lower case; the empty string stays."""
    return ascii_lower(F.regexp_replace(c, r"""(?U)\A[\s"'<>]+|[\s"'<>]+\z""", ""))


def message_id(c: Column) -> Column:
    """bare_id of the sanitised token, or null without an @."""
    token = bare_id(sanitize_text(c))
    return F.when(token.contains("@"), token)


def message_ids(c: Column) -> Column:
    """All <...> tokens or, if none of them is an id, the tokens between white space, commas and semicolons."""
    ids = lambda tokens: F.filter(F.transform(tokens, message_id), lambda t: t.isNotNull())
    marked = ids(F.regexp_extract_all(c, F.lit(r"<([^<>\s]+)>"), F.lit(1)))
    return F.when(F.size(marked) > 0, marked).otherwise(ids(F.split(c, r"(?U)[\s,;]+")))


def dedupe_in_order(c: Column) -> Column:
    return F.array_distinct(c)


def text_for_hash(c: Column) -> Column:
    """Lines without white space at their ends; a final line end goes."""
    return F.regexp_replace(F.regexp_replace(normalize_line_endings(c), r"\n\z", ""), r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")


def content_hash(subject: Column, sender: Column, date: Column, references: Column, replies: Column, to: Column, cc: Column, body: Column) -> Column:
    """SHA-256 (32 bytes) of seven named headers, an empty line and the body."""
    heads = (("Subject", subject), ("From", sender), ("Date", date), ("References", F.array_join(references, " ")), ("In-Reply-To", F.array_join(replies, " ")), ("To", to), ("Cc", cc))
    parts = [x for name, value in heads for x in (F.lit(name + ":"), text_for_hash(F.coalesce(value, F.lit(""))), F.lit("\n"))]
    return F.unhex(F.sha2(F.concat(*parts, F.lit("\n"), text_for_hash(F.coalesce(body, F.lit("")))), 256))


def has_diff_markers(c: Column) -> Column:
    return normalize_line_endings(c).rlike(MARK)


def diff_text(c: Column) -> Column:
    """From the first diff marker on, stripped; null without one."""
    lf = normalize_line_endings(c)
    at = F.regexp_instr(lf, F.lit(MARK))
    return F.when(at > 0, strip(F.substr(lf, at)))


def prose(c: Column) -> Column:
    """All of the text before the first diff; empty if there is only a diff."""
    lf = normalize_line_endings(F.coalesce(c, F.lit("")))
    at = F.regexp_instr(lf, F.lit(MARK))
    return sanitize_text(F.when(at > 0, F.substr(lf, F.lit(1), at - 1)).otherwise(lf))


def search_text(c: Column) -> Column:
    """What is indexed of the prose: at most 80,000 characters."""
    return F.left(prose(c), F.lit(80_000))


def trailer(c: Column, name: str) -> Column:
    """The lower-cased value of a 'name: value' line; null without one."""
    found = F.regexp_extract(c, rf"(?im)^{name}:\s*(\S+)", 1)
    return F.when(found != "", F.lower(found))


def safe_prefix(c: Column, n: Column) -> Column:
    return F.left(F.coalesce(c, F.lit("")), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)))


def snippet(c: Column, n: int = 220) -> Column:
    """White space collapsed, cut to n characters with ... behind; null if nothing is left."""
    flat = collapse(c)
    return F.when(flat != "", F.when(F.char_length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("..."))).otherwise(flat))


def for_log(c: Column, n: int) -> Column:
    """White space collapsed; longer texts end in ... within n characters."""
    flat = collapse(c)
    return F.when(F.char_length(flat) > n, F.concat(F.left(flat, F.lit(max(0, n - 3))), F.lit("..."))).otherwise(flat)


def embedding_text(*parts: Column) -> Column:
    """Non-empty parts, collapsed and joined by spaces, at most 16,000 characters."""
    kept = F.filter(F.array(*[collapse(F.coalesce(p, F.lit(""))) for p in parts]), lambda p: p != "")
    return F.left(F.array_join(kept, " "), F.lit(16_000))


def hash_text(c: Column) -> Column:
    return F.sha2(c, 256)


def strip_quoted_lines(c: Column) -> Column:
    """Without lines that begin, after white space, with >, and without white space at the end."""
    kept = F.filter(F.split(normalize_line_endings(c), "\n"), lambda line: ~line.rlike(r"(?U)\A\s*>"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"(?U)\s+\z", "")


def slice_bytes(c: Column, start: Column, end: Column) -> Column:
    """Bytes [start, end) of the UTF-8 text; null if they are no valid bounds."""
    raw = F.encode(c, "UTF-8")
    ok = (start >= 0) & (start <= end) & (end <= F.octet_length(c))
    return F.when(ok, F.try_validate_utf8(F.substring(raw, start + 1, end - start).cast("string")))


def query_prompt(c: Column, scope: str) -> Column:
    """A search query, collapsed, behind the sentence that its scope's vectors were made with."""
    return F.concat(F.lit(f"Find the {scope} that matches this query: "), collapse(c))
