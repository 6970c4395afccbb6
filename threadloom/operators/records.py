"""Upserts with rules of their own, watermarks, and references from versions to threads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import merge


def upsert_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items by (version_id, ordinal). A patch isn't replaced by what is no patch or has no diff: of
    that, only the total is taken. Elsewhere the new values stand; a patch id once known stays where none comes."""
    t, s = (lambda c: F.col(f"t.{c}")), (lambda c: F.col(f"s.{c}"))
    kept = (t("item_type") == "patch") & ((s("item_type") != "patch") | ~s("has_diff"))
    rules = {c: F.when(kept, t(c)).otherwise(s(c)) for c in old.columns}
    rules |= {"total": "fill", "patch_id_stable": F.when(kept, t("patch_id_stable")).otherwise(F.coalesce(s("patch_id_stable"), t("patch_id_stable")))}
    return merge(old, new, ["version_id", "ordinal"], rules)


def replace_canonical(matches: DataFrame, new: DataFrame) -> DataFrame:
    """Matches by (item_id, commit_oid): those in new become the canonical ones of their items, all others of these items none."""
    again = new.select("item_id").distinct().withColumn("_again", F.lit(True))
    old = matches.join(again, "item_id", "left").withColumn("is_canonical", F.col("is_canonical") & F.col("_again").isNull()).drop("_again")
    return merge(old, new.withColumn("is_canonical", F.lit(True)), ["item_id", "commit_oid"], {})


def advanced(watermarks: DataFrame, new: DataFrame, reset: DataFrame | None = None) -> DataFrame:
    """Watermarks by (list_id, repo_key), overwritten by new ones; those of the repositories in reset are null afterwards."""
    keys = ["list_id", "repo_key"]
    both = merge(watermarks, new, keys, {})
    if reset is None:
        return both
    gone = both.join(reset.select(*keys).distinct().withColumn("_reset", F.lit(True)), keys, "left")
    return gone.select(*keys, *[F.when(F.col("_reset").isNull(), F.col(c)).alias(c) for c in watermarks.columns if c not in keys])


def thread_refs(versions: DataFrame, instances: DataFrame, members: DataFrame, list_id, start=None, end=None) -> DataFrame:
    """version_id, anchor, thread_id, status of the versions that a list may lack references of.

    The anchor is the cover or else the first patch; versions whose anchor the list got in
    start <= seen_at < end are looked at, and those without one. A reference is found only if the
    anchor is in one thread of the list; else the status is no_anchor, missing or duplicate.
    """
    v = versions.select("version_id", F.coalesce("cover_message_pk", "first_patch_message_pk").alias("anchor"))
    seen = instances.where(F.col("list_id") == F.lit(list_id))
    seen = seen if start is None else seen.where(F.col("seen_at") >= F.lit(start))
    seen = seen if end is None else seen.where(F.col("seen_at") < F.lit(end))
    here = v.join(seen.select(F.col("message_pk").alias("anchor")), "anchor", "left_semi").unionByName(v.where("anchor is null"))
    threads = members.where(F.col("list_id") == F.lit(list_id)).groupBy(F.col("message_pk").alias("anchor")).agg(F.min("thread_id").alias("_least"), F.max("thread_id").alias("_most"))
    both = here.join(threads, "anchor", "left")
    status = F.when(F.col("anchor").isNull(), "no_anchor").when(F.col("_least").isNull(), "missing").when(F.col("_least") != F.col("_most"), "duplicate").otherwise("found")
    return both.withColumn("status", status).select("version_id", "anchor", F.when(F.col("status") == "found", F.col("_least")).alias("thread_id"), "status")
