"""Keys, dates, tags and small numbers as Column expressions."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import message_id

TAG = r"\A\s*v(\d+)\.(\d+)(?:\.(\d+))?(?:-rc(\d+))?\s*\z"
#: Which change type stays when two meet: M yields to any, else the earlier in this order.
CHANGE_ORDER = ("B", "R", "C", "A", "D", "M")


def sort_key(path: Column) -> Column:
    """The bytes of a path of sibling ranks, which sort as the tree does."""
    return F.unhex(F.array_join(F.transform(path, lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")), ""))


def tag_parts(tag: Column) -> Column:
    """struct(major, minor, patch, rc, release_sort_key, tag_sort_key, release) of a version tag; null for other tags."""
    part = lambda i: F.regexp_extract(tag, TAG, i)
    number = lambda i: F.coalesce(F.nullif(part(i), F.lit("")).cast("long"), F.lit(0))
    release = number(1) * 1_000_000_000 + number(2) * 1_000_000 + number(3) * 1_000
    name = F.concat(F.lit("v"), number(1).cast("string"), F.lit("."), number(2).cast("string"), F.when(number(3) > 0, F.concat(F.lit("."), number(3).cast("string"))).otherwise(F.lit("")))
    rc = F.nullif(part(4), F.lit("")).cast("long")
    return F.when(tag.rlike(TAG), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), rc.alias("rc"), release.alias("release_sort_key"), (release + F.coalesce(rc, F.lit(999))).alias("tag_sort_key"), name.alias("release")))


#: Fixed forms of links to archived messages: the host, an optional list, and the message id.
LINKS = (r"(?im)^\s*link:\s*https?://(?:[^/\s]+\.)?lore\.kernel\.org/(?:[^/\s]+/)?([^/?#\s]+)/?", r"(?im)^\s*link:\s*https?://lkml\.kernel\.org/r/([^/?#\s]+)")


def link_message_ids(body: Column) -> Column:
    """Sorted ids of the messages that a commit's Link: lines name; + stays a plus."""
    raw = F.concat(*[F.regexp_extract_all(body, F.lit(p), F.lit(1)) for p in LINKS])
    ids = F.transform(raw, lambda r: message_id(F.coalesce(F.try_url_decode(F.replace(r, F.lit("+"), F.lit("%2B"))), r)))
    return F.array_sort(F.array_distinct(F.filter(ids, lambda i: i.isNotNull())))


def epoch_number(path: Column) -> Column:
    """n of git/<n>.git, else null."""
    return F.nullif(F.regexp_extract(path, r"\Agit/(\d+)\.git\z", 1), F.lit("")).cast("long")


def backoff(base: Column, most: Column, attempt: Column) -> Column:
    return F.least(base.cast("double") * F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1)) - 1), most.cast("double")).cast("long")


def is_stuck(lease_until: Column, now: Column) -> Column:
    return F.coalesce(lease_until < now, F.lit(False))


def split_date(ts: Column) -> Column:
    return F.struct(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("date_utc"), F.unix_seconds(ts.cast("timestamp")).alias("date_ts"), F.year(ts).alias("year"), F.month(ts).alias("month"))


def merged_change_type(types: Column) -> Column:
    """The change type that stays of an array of them."""
    rank = F.transform(types, lambda t: F.array_position(F.array(*map(F.lit, CHANGE_ORDER)), t))
    return F.element_at(F.array(*map(F.lit, CHANGE_ORDER)), F.array_min(F.filter(rank, lambda r: r > 0)).cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are not alike."""
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def ids_hash(ids: Column) -> Column:
    """SHA-256 of the sorted distinct ids as big-endian 64-bit numbers."""
    return F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(F.array_distinct(ids)), lambda n: F.lpad(F.hex(n), 16, "0")), "")), 256)


# Parameters of the read API, checked before a plan is built.


def clamp_limit(limit: int | None, default: int, most: int) -> int:
    return max(1, min(default if limit is None else limit, most))


def window_days(text: str | None) -> int:
    found = re.fullmatch(r"(\d+)d", (text or "30d").strip())
    if not found or not 1 <= int(found[1]) <= 3650:
        raise ValueError(f"a window is 1d to 3650d, not {text!r}")
    return int(found[1])


def timestamp(text: str | None) -> dt.datetime | None:
    """RFC 3339, or a date at midnight UTC; nothing for a blank."""
    if not (text or "").strip():
        return None
    at = dt.datetime.fromisoformat(text.strip())
    return at.replace(tzinfo=dt.UTC) if at.tzinfo is None else at.astimezone(dt.UTC)
