"""Search over documents as threads, embeddings as vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_prompt
from ..operators.search import FIELDS, bootstrap_counts, cosine, embedding_inputs, facets, hybrid, lexical_score, search, series_documents, thread_documents
from ._base import Tables, query


def documents(t: Tables) -> DataFrame:
    """Documents as search documents of threads."""
    d = t.documents
    return d.select(F.concat(F.lit("thread-"), F.col("doc_id").cast("string")).alias("doc_id"), F.array(F.coalesce("source", F.lit("none"))).alias("list_keys"), F.coalesce("source", F.lit("")).alias("subject"), F.array(F.concat(F.coalesce("lang", F.lit("")), F.lit("@x"))).alias("author_emails"), F.coalesce("lang", F.lit("")).alias("participants_joined"), (F.col("doc_id") % 2 == 0).alias("has_diff"), F.coalesce("text", F.lit("")).alias("snippet_corpus"), F.col("doc_id").alias("date_ts"))


_DOCS = "SELECT 'thread-' || doc_id AS doc_id, coalesce(source, 'none') AS list_key, coalesce(lang, '') || '@x' AS author, doc_id % 2 = 0 AS has_diff, doc_id AS date_ts, lower(coalesce(source, '')) AS f1, lower(coalesce(lang, '')) AS f2, ' ' || regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\p{L}\\p{N}_]+', ' ', 'g') || ' ' AS f3 FROM documents"


@query(f"SELECT 'list_keys' AS facet, list_key AS value, count(*) AS n FROM ({_DOCS}) GROUP BY 2 UNION ALL SELECT 'author_emails', author, count(*) FROM ({_DOCS}) GROUP BY 2 UNION ALL SELECT 'has_diff', CASE WHEN has_diff THEN 'true' ELSE 'false' END, count(*) FROM ({_DOCS}) GROUP BY 2")
def search_facets(t: Tables) -> DataFrame:
    """Counts of all facets in one pass."""
    return facets(documents(t), "thread")


@query(f"SELECT doc_id, date_ts FROM ({_DOCS}) WHERE list_key = 'src10' AND author = 'en@x' AND has_diff AND date_ts >= 10 AND date_ts < 900 ORDER BY date_ts DESC LIMIT 20")
def search_by_date(t: Tables) -> DataFrame:
    """Filters, newest first, a page of twenty."""
    return search(documents(t), "thread", "", sort="date_desc", list_key="src10", author="en@x", has_diff=True, start=10, end=900).select("doc_id", "date_ts")


@query(f"""SELECT doc_id, round((CAST(f1 = 'src3' AS INTEGER) + (CAST(f2 = 'en' AS INTEGER)) / 2.0 + (CAST(contains(f3, ' and ') AS INTEGER) + CAST(contains(f3, ' en ') AS INTEGER) + CAST(contains(f3, ' src3 ') AS INTEGER)) / 3.0) / 3 / (11.0 / 6), 6) AS score FROM ({_DOCS})""")
def search_scores(t: Tables) -> DataFrame:
    """Q2, Q3: our own ranking: coverage of the query's words, fields weighted in order."""
    return documents(t).select("doc_id", F.round(lexical_score("and en src3", FIELDS["thread"]), 6).alias("score"))


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(0.65 * CAST(label = 1 AS INTEGER) + 0.35 * list_inner_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[])) / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))), 5) AS score FROM embeddings, q""")
def hybrid_scores(t: Tables) -> DataFrame:
    """Q7: lexical and vector scores mixed, in double precision."""
    q = t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("v"))  # one row
    both = t.embeddings.join(F.broadcast(q))
    return both.select("vec_id", F.round(hybrid((F.col("label") == 1).cast("double"), cosine(F.col("embedding"), F.col("v"))), 5).alias("score"))


@query("""SELECT 'thread-1-' || conv_id AS doc_id, count(*) AS message_count, bool_or(role = 'assistant') AS has_diff, array_to_string(list_sort(list(DISTINCT role || '@x')), ',') AS authors, min(turn) AS date_ts,
md5(left(string_agg(left(coalesce(text, ''), 400), ' ' ORDER BY turn, left(coalesce(text, ''), 400)), 20000)) AS corpus_md5 FROM conversations GROUP BY conv_id""")
def search_thread_documents(t: Tables) -> DataFrame:
    """Documents of threads."""
    c = t.conversations
    messages = c.select(F.lit(1).alias("list_id"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("sort_key"), F.col("role").alias("from_name"), F.concat("role", F.lit("@X")).alias("from_email"), F.col("text").alias("body"), (F.col("role") == "assistant").alias("has_diff"))
    threads = c.groupBy(F.col("conv_id").alias("thread_id")).agg(F.timestamp_seconds(F.min("turn")).alias("last_activity_at")).select(F.lit(1).alias("list_id"), F.lit("l").alias("list_key"), "thread_id", F.lit("S").alias("subject"), "last_activity_at")
    return thread_documents(threads, messages).select("doc_id", F.col("message_count").cast("long").alias("message_count"), "has_diff", F.array_join("author_emails", ",").alias("authors"), "date_ts", F.md5("snippet_corpus").alias("corpus_md5"))


@query("""SELECT 'series-' || o_custkey AS doc_id, bool_or(l_returnflag = 'R') AS has_diff, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS lists, md5(array_to_string(list_transform(list_sort(list(DISTINCT {'ordinal': l_linenumber, 'subject': l_returnflag})), lambda s: s.subject), ' ')) AS subjects_md5
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def search_series_documents(t: Tables) -> DataFrame:
    """Documents of series."""
    rows = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).withColumnRenamed("o_custkey", "series_id")
    series = rows.groupBy("series_id").agg(F.max("o_orderdate").alias("last_seen_at")).withColumns({"canonical_subject": F.lit("s"), "author_email": F.lit("a"), "cover_abstract": F.lit(""), "merge_state": F.lit("merged")})
    docs = series_documents(series, rows.select("series_id", F.col("l_linenumber").alias("ordinal"), F.col("l_returnflag").alias("subject"), (F.col("l_returnflag") == "R").alias("has_diff")), rows.select("series_id", F.col("o_orderpriority").alias("list_key")))
    return docs.select("doc_id", "has_diff", F.array_join("list_keys", ",").alias("lists"), F.md5("patch_subjects_joined").alias("subjects_md5"))


@query(r"""SELECT doc_id, sha256(left(flat, 16000)) AS source_hash FROM (SELECT 'thread-' || doc_id AS doc_id, trim(trim(coalesce(source, '')) || ' ' || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS flat FROM documents) WHERE flat <> ''""")
def vector_inputs(t: Tables) -> DataFrame:
    """Texts for vectors and their digests; documents without text have none."""
    return embedding_inputs(documents(t), "subject", "snippet_corpus").select("doc_id", "source_hash")


@query(r"""SELECT doc_id, md5('Find the ' || scope || ' that matches this query: ' || trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS prompt_md5, scope FROM documents, (SELECT unnest(['thread', 'series']) AS scope)""")
def query_prompts(t: Tables) -> DataFrame:
    """whole texts as search queries, behind the sentence of each scope."""
    texts = t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    of = lambda scope: texts.select("doc_id", F.md5(query_prompt(F.col("text"), scope)).alias("prompt_md5"), F.lit(scope).alias("scope"))
    return of("thread").unionByName(of("series"))


@query("SELECT count(*) AS documents, count(e.vec_id) AS with_vector, count(*) FILTER (WHERE e.vec_id IS NULL) AS without_vector FROM documents d LEFT JOIN (SELECT vec_id FROM embeddings WHERE label <> 0) e ON e.vec_id = d.doc_id")
def index_bootstrap(t: Tables) -> DataFrame:
    """Documents with and without a stored vector."""
    return bootstrap_counts(t.documents.select("doc_id"), t.embeddings.where("label <> 0").select(F.col("vec_id").alias("doc_id")))


@query("SELECT doc_id, 8 AS dimensions, true AS unit FROM (SELECT 'thread-' || doc_id AS doc_id FROM documents)")
def generated_vectors(t: Tables) -> DataFrame:
    """Vectors from a pluggable embedder, in batches, checked for number and length."""
    from ..sources.repos import embed, hash_embedder

    v = embed(embedding_inputs(documents(t), "subject", "snippet_corpus"), hash_embedder(8), 8)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return v.select("doc_id", F.size("embedding").alias("dimensions"), ((F.abs(norm - 1) < 1e-4) | (norm < 1e-9)).alias("unit"))


@query("SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS version FROM embeddings QUALIFY version = 1")
def vector_upsert(t: Tables) -> DataFrame:
    """The last vector written for a key wins."""
    from ..operators.relational import newest

    return newest(t.embeddings, ["label"], [F.desc("vec_id")]).select("vec_id", "label", F.lit(1).cast("long").alias("version"))
