"""Patches and the commits that merged them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsers import commit_subject_udf
from ..functions.scalars import link_message_ids, tag_parts
from .components import earliest_reaching


def mainline_commits(commits: DataFrame, after: str | None = None) -> DataFrame:
    """Commits that aren't merges, since a time."""
    rows = commits.where(F.coalesce(F.size("parents"), F.lit(0)) <= 1)
    return rows.where(F.col("committed_at") > F.lit(after).cast("timestamp")) if after else rows


def version_tags(tags: DataFrame) -> DataFrame:
    """Tags that name a version, with their sort keys."""
    return tags.withColumn("t", tag_parts(F.col("tag_name"))).where("t is not null").select("tag_name", "target_oid", "t.*")


def first_tags(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """commit_oid with the first tag and the first final release that contain it."""
    named = version_tags(tags)
    parents = commits.select(F.col("commit_oid").alias("node"), F.explode("parents").alias("parent"))
    rank = F.row_number().over(Window.orderBy("tag_sort_key", "tag_name"))  # tags are few
    ranked = named.withColumn("rank", rank)
    first = earliest_reaching(ranked.select(F.col("target_oid").alias("node"), "rank"), parents)
    final = earliest_reaching(ranked.where("rc is null").select(F.col("target_oid").alias("node"), "rank"), parents)
    tag = ranked.select("rank", F.col("tag_name").alias("first_containing_tag"), F.col("tag_sort_key").alias("first_tag_sort_key"))
    release = ranked.select("rank", F.col("release").alias("first_final_release"), F.col("release_sort_key").alias("first_release_sort_key"))
    a = first.join(tag, "rank").select(F.col("node").alias("commit_oid"), "first_containing_tag", "first_tag_sort_key")
    b = final.join(release, "rank").select(F.col("node").alias("commit_oid"), "first_final_release", "first_release_sort_key")
    return commits.select("commit_oid").join(a, "commit_oid", "left").join(b, "commit_oid", "left")


def match_commits(commits: DataFrame, items: DataFrame, aliases: DataFrame, existing: DataFrame) -> DataFrame:
    """(item_id, commit_oid, match_method, matched_message_id): for each patch item the first commit
    that links to one of its message's ids or has its patch id, links before patch ids.

    commits (commit_oid, committed_at, subject, body, patch_id_stable), items (item_id, message_pk,
    patch_id, subject), aliases (message_id, message_pk), existing (item_id): matched before. If
    what a commit names is ambiguous, only items with the commit's subject count.
    """
    c = commits.select("commit_oid", "committed_at", "body", "patch_id_stable", commit_subject_udf("subject").alias("commit_subject"))
    links = c.select("commit_oid", "committed_at", "commit_subject", F.explode(link_message_ids(F.col("body"))).alias("message_id"))
    linked = links.join(aliases, "message_id").join(items, "message_pk")
    alone = Window.partitionBy("commit_oid")
    linked = linked.withColumn("_kinds", F.size(F.collect_set(F.coalesce("subject", F.lit(""))).over(alone))).where((F.col("_kinds") <= 1) | (F.col("subject") == F.col("commit_subject")))
    same = c.where("patch_id_stable is not null").join(items.where("patch_id is not null"), F.col("patch_id_stable") == F.col("patch_id"))
    same = same.withColumn("_kinds", F.count("*").over(alone)).where((F.col("_kinds") <= 1) | (F.col("subject") == F.col("commit_subject")))
    rows = linked.select("item_id", "commit_oid", "committed_at", F.lit("link").alias("match_method"), F.col("message_id").alias("matched_message_id"))
    rows = rows.unionByName(same.select("item_id", "commit_oid", "committed_at", F.lit("patch_id").alias("match_method"), F.lit(None).cast("string").alias("matched_message_id")))
    order = Window.partitionBy("item_id").orderBy("committed_at", "commit_oid", "match_method", "matched_message_id")
    best = rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank", "committed_at")
    return best.join(existing.select("item_id"), "item_id", "left_anti")


def version_rollup(assembled: DataFrame, matches: DataFrame) -> DataFrame:
    """Merge state of each version over its assembled patches: unmerged, partial or merged, with the
    latest tag and release. assembled (version_id, ordinal, item_id), matches (item_id, commit_oid, tag, tag_key, release, release_key)."""
    rows = assembled.where("ordinal > 0").join(matches, "item_id", "left")
    out = rows.groupBy("version_id").agg(F.count("*").alias("total"), F.count("commit_oid").alias("matched"), F.max_by("tag", "tag_key").alias("tag"), F.max_by("release", "release_key").alias("release"), F.max("commit_oid").alias("_commit"))
    state = F.when(F.col("matched") == 0, "unmerged").when(F.col("matched") < F.col("total"), "partial").otherwise("merged")
    return out.select("version_id", "total", "matched", state.alias("state"), "tag", "release", F.when((F.col("total") == 1) & (F.col("matched") == 1), F.col("_commit")).alias("single_commit"))


def series_rollup(versions: DataFrame) -> DataFrame:
    """Of each series the newest merged version, else the best partial, else the newest. versions (series_id, version_id, version_num, sent_at, state, total, matched)."""
    newest = F.struct("version_num", "sent_at", "version_id")
    pick = F.when(F.col("state") == "merged", F.struct(F.lit(2), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("t"), newest.alias("n"))).when(F.col("state") == "partial", F.struct(F.lit(1), F.col("matched").alias("m"), F.col("total").alias("t"), newest.alias("n"))).otherwise(F.struct(F.lit(0), F.lit(0).cast("long").alias("m"), F.lit(0).cast("long").alias("t"), newest.alias("n")))
    return versions.groupBy("series_id").agg(F.max_by(F.struct("version_id", "version_num", "state"), pick).alias("b")).select("series_id", "b.*")
