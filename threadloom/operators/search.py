"""Search documents, vectors, ranking, facets and diagnostics."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import split_date
from ..functions.text import ascii_lower, collapse, embedding_text, hash_text, safe_prefix, snippet

#: Searchable fields of each scope in order of weight; a hit in the first counts most.
FIELDS = {"thread": ("subject", "participants_joined", "snippet_corpus"), "series": ("canonical_subject", "cover_abstract", "patch_subjects_joined")}
FACETS = {"thread": ("list_keys", "author_emails", "has_diff"), "series": ("list_keys", "author_email", "has_diff")}


def sorted_set(c: Column) -> Column:
    """Distinct values in order, without nulls; empty if there are none."""
    return F.array_sort(F.collect_set(c))


def thread_documents(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """One document a thread: threads (list_id, list_key, thread_id, subject, last_activity_at),
    messages (list_id, thread_id, sort_key, from_name, from_email, body, has_diff)."""
    per = messages.groupBy("list_id", "thread_id").agg(
        F.count("*").alias("message_count"), F.bool_or(F.coalesce("has_diff", F.lit(False))).alias("has_diff"), sorted_set(ascii_lower(F.col("from_email"))).alias("author_emails"), sorted_set(F.col("from_name")).alias("participants"),
        F.array_sort(F.collect_list(F.struct("sort_key", safe_prefix(F.col("body"), F.lit(400)).alias("t")))).alias("_texts"),
    )
    docs = threads.join(per, ["list_id", "thread_id"], "left")
    return docs.select(
        F.concat(F.lit("thread-"), F.col("list_id").cast("string"), F.lit("-"), F.col("thread_id").cast("string")).alias("doc_id"), F.array("list_key").alias("list_keys"), collapse(F.coalesce("subject", F.lit(""))).alias("subject"), F.coalesce("author_emails", F.array().cast("array<string>")).alias("author_emails"),
        F.array_join(F.coalesce("participants", F.array().cast("array<string>")), " ").alias("participants_joined"), F.coalesce("message_count", F.lit(0)).alias("message_count"), F.coalesce("has_diff", F.lit(False)).alias("has_diff"),
        F.left(F.array_join(F.transform("_texts", lambda t: t["t"]), " "), F.lit(20_000)).alias("snippet_corpus"), F.unix_seconds(F.col("last_activity_at").cast("timestamp")).alias("date_ts"), snippet(F.coalesce(F.col("_texts")[0]["t"], F.lit(""))).alias("snippet"),
    )


def series_documents(series: DataFrame, items: DataFrame, lists: DataFrame) -> DataFrame:
    """One document a series: series (series_id, canonical_subject, author_email, last_seen_at, cover_abstract, merge_state), items (series_id, ordinal, subject, has_diff), lists (series_id, list_key)."""
    per = items.groupBy("series_id").agg(F.bool_or("has_diff").alias("has_diff"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ordinal", "subject"))), lambda s: s["subject"]), " ").alias("patch_subjects_joined"))
    on = lists.groupBy("series_id").agg(sorted_set(F.col("list_key")).alias("list_keys"))
    docs = series.join(per, "series_id", "left").join(on, "series_id", "left")
    return docs.select(F.concat(F.lit("series-"), F.col("series_id").cast("string")).alias("doc_id"), F.coalesce("list_keys", F.array().cast("array<string>")).alias("list_keys"), "canonical_subject", "author_email", F.coalesce("has_diff", F.lit(False)).alias("has_diff"), F.coalesce("cover_abstract", F.lit("")).alias("cover_abstract"), F.coalesce("patch_subjects_joined", F.lit("")).alias("patch_subjects_joined"), "merge_state", F.unix_seconds(F.col("last_seen_at").cast("timestamp")).alias("date_ts"))


def patch_item_documents(items: DataFrame, versions: DataFrame, series: DataFrame, messages: DataFrame, files: DataFrame, lists: DataFrame) -> DataFrame:
    """One document an item: items (item_id, version_id, message_pk, ordinal, subject, commit_subject, has_diff), versions (version_id, series_id,
    version_num, is_rfc, sent_at), series (series_id, author_email), messages (message_pk, message_id_primary, diff_text), files (item_id, new_path), lists (series_id, list_key)."""
    paths = files.groupBy("item_id").agg(sorted_set(F.col("new_path")).alias("file_paths"))
    on = lists.groupBy("series_id").agg(sorted_set(F.col("list_key")).alias("list_keys"))
    of = versions.join(series.select("series_id", "author_email"), "series_id").join(on, "series_id", "left")
    cut = messages.select("message_pk", "message_id_primary", safe_prefix(F.col("diff_text"), F.lit(60_000)).alias("diff_search"))
    rows = items.join(of, "version_id").join(paths, "item_id", "left").hint("shuffle_hash").join(cut, "message_pk")  # texts are cut before they move, move once and are never sorted
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("item_id").alias("id"), F.lit("patch_item").alias("scope"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("doc_id"), "subject", snippet(F.coalesce("commit_subject", "subject"), 240).alias("snippet"), "author_email", split_date(F.col("sent_at")).alias("_date"),
        F.coalesce("list_keys", none).alias("list_keys"), "has_diff", "series_id", "version_id", "version_num", "ordinal", "is_rfc", F.coalesce("file_paths", none).alias("file_paths"), "commit_subject", "diff_search", "message_id_primary",
    ).select("*", "_date.*").drop("_date")


def series_metadata(series: DataFrame, versions: DataFrame) -> DataFrame:
    """What changes of a series without a new document: series (series_id, latest_version_id, merge_state, merged_in_tag,
    merged_in_release, merged_version_id, merged_commit_id), versions (version_id, version_num, is_rfc)."""
    latest = versions.select(F.col("version_id").alias("latest_version_id"), F.col("version_num").alias("_num"), F.col("is_rfc").alias("_rfc"))
    both = series.join(latest, "latest_version_id", "left")
    has = F.col("_num").isNotNull()
    return both.select(
        "series_id", F.coalesce("_num", F.lit(1)).alias("latest_version_num"), F.when(has, F.col("latest_version_id")).alias("latest_version_id"), F.coalesce("_rfc", F.lit(False)).alias("is_rfc_latest"),
        "merge_state", (F.col("merge_state") == "merged").alias("is_merged"), "merged_in_tag", "merged_in_release", "merged_version_id", "merged_commit_id",
    )


def thread_metadata(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """The same of threads (thread_id, list_key, created_at, last_activity_at, message_count, root_message_pk), with who began them: messages (message_pk, from_name, from_email)."""
    starter = messages.select(F.col("message_pk").alias("root_message_pk"), F.col("from_name").alias("starter_name"), F.col("from_email").alias("starter_email"))
    return threads.join(starter, "root_message_pk", "left").select("thread_id", "list_key", "created_at", "last_activity_at", "message_count", "starter_name", "starter_email")


def backfilled(hits: DataFrame, metadata: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Hits whose null fields come from metadata; hits that lack none aren't joined."""
    lacks = functools.reduce(operator.or_, [F.col(f).isNull() for f in fields])
    more = metadata.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    filled = hits.where(lacks).join(more, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in fields else F.col(c) for c in hits.columns])
    return hits.where(~lacks).unionByName(filled)


def embedding_inputs(docs: DataFrame, *parts: str) -> DataFrame:
    """doc_id, text, source_hash of documents with any text."""
    return docs.select("doc_id", embedding_text(*map(F.col, parts)).alias("text")).where("text <> ''").withColumn("source_hash", hash_text(F.col("text")))


def filtered(docs: DataFrame, scope: str, *, list_key=None, author=None, merged=None, has_diff=None, start=None, end=None, ready: bool = True) -> DataFrame:
    """Documents that pass the filters that are set; dates are start <= date_ts < end."""
    if merged is not None:
        if scope != "series":
            raise ValueError("only series have a merge state")
        if not ready:
            raise RuntimeError("the merge filter isn't ready before the first mainline scan has ended")
        docs = docs.where(F.col("merge_state") == "merged" if merged else F.col("merge_state") != "merged")
    if list_key is not None:
        docs = docs.where(F.array_contains("list_keys", list_key))
    if author is not None:
        docs = docs.where(F.array_contains("author_emails", author.lower()) if scope == "thread" else F.col("author_email") == author.lower())
    if has_diff is not None:
        docs = docs.where(F.col("has_diff") == has_diff)
    if start is not None:
        docs = docs.where(F.col("date_ts") >= start)
    return docs if end is None else docs.where(F.col("date_ts") < end)


def words_of(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(c), r"(?U)[^\p{L}\p{N}_]+"), lambda w: w != ""))


def wanted_words(query: str) -> list[str]:
    return sorted({w for w in "".join(ch if ch.isalnum() or ch == "_" else " " for ch in query.lower()).split()})


def cropped(text: Column, query: str, n: int, begin: str = "<em>", end: str = "</em>") -> Column:
    """n words of a text around the first that the query has, or its first n; words of the query stand
    between begin and end, and ... where words are missing. Empty for a null or blank text."""
    words = F.filter(F.split(collapse(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    wanted = F.array(*map(F.lit, wanted_words(query))).cast("array<string>")
    is_hit = lambda w: F.array_contains(wanted, F.regexp_replace(ascii_lower(w), r"\A[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+\z", ""))

    def around(parts: Column) -> Column:
        first = F.array_position(F.transform(parts, is_hit), F.lit(True)).cast("int")  # from 1; 0 for none
        start = F.greatest(F.lit(0), F.least(first - 1 - n // 2, F.size(parts) - n))
        shown = F.array_join(F.transform(F.slice(parts, start + 1, F.lit(n)), lambda w: F.when(is_hit(w), F.concat(F.lit(begin), w, F.lit(end))).otherwise(w)), " ")
        return F.concat(F.when(start > 0, "...").otherwise(""), shown, F.when(start + n < F.size(parts), "...").otherwise(""))

    return F.get(F.transform(F.array(words), around), F.lit(0))


def lexical_score(query: str, fields: tuple[str, ...]) -> Column:
    """Share of the query's words that a field has, fields weighted 1, 1/2, 1/3, ...; 0 to 1. The
    ranking is ours: term coverage, then the field's weight, then the id."""
    wanted = wanted_words(query)
    if not wanted:
        return F.lit(0.0)
    weights = [1 / (i + 1) for i in range(len(fields))]
    parts = [F.size(F.array_intersect(words_of(F.coalesce(F.col(f), F.lit(""))), F.array(*map(F.lit, wanted)))) * (w / len(wanted) / sum(weights)) for f, w in zip(fields, weights)]
    return functools.reduce(operator.add, parts)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null if a vector is zero or the lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def hybrid(lexical: Column, semantic: Column, ratio: float = 0.35) -> Column:
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio is between 0 and 1")
    return (1 - ratio) * lexical + ratio * F.coalesce(semantic, F.lit(0.0))


def search(docs: DataFrame, scope: str, query: str, *, sort: str = "relevance", limit: int = 20, offset: int = 0, vectors: DataFrame | None = None, vector: list[float] | None = None, ratio: float = 0.35, **filters) -> DataFrame:
    """A page of hits with scores. Filters come first and reach the scan; date_desc sorts by date and id."""
    hits = filtered(docs, scope, **filters).withColumn("_lexical", lexical_score(query, FIELDS[scope]))
    if vector is not None and vectors is not None:
        hits = hits.join(vectors, "doc_id", "left").withColumn("score", hybrid(F.col("_lexical"), cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in vector])), ratio)).drop("embedding")
    else:
        hits = hits.withColumn("score", F.col("_lexical"))
        hits = hits.where("score > 0") if query.strip() else hits
    order = [F.desc("date_ts"), F.desc("doc_id")] if sort == "date_desc" else [F.desc("score"), F.asc("doc_id")]
    return hits.drop("_lexical").orderBy(*order).offset(offset).limit(limit)


def _named(facet: str):
    return lambda value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))


def facets(docs: DataFrame, scope: str) -> DataFrame:
    """facet, value, n of every facet in one pass over the documents."""
    values = [F.transform(F.col(f) if f.endswith(("_keys", "_emails")) else F.array(F.col(f).cast("string")), _named(f)) for f in FACETS[scope]]
    return docs.select(F.explode(F.concat(*values)).alias("x")).select("x.*").where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def drift(stored: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """key, stored, indexed, delta; what the index lacks counts as 0."""
    return stored.join(indexed, key, "left").select(key, "stored", F.coalesce("indexed", F.lit(0)).alias("indexed")).withColumn("delta", F.col("indexed") - F.col("stored"))


def bootstrap_counts(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Documents, and how many of them have a stored vector or none."""
    both = docs.select("doc_id").join(vectors.select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    return both.agg(F.count("*").alias("documents"), F.count("has").alias("with_vector"), F.count_if(F.col("has").isNull()).alias("without_vector"))
