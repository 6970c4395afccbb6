"""Records that are upserted: items, matches, watermarks, references; and documents made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import advanced, replace_canonical, thread_refs, upsert_items
from ..operators.search import backfilled, cropped, patch_item_documents, series_metadata, thread_metadata
from ..sources.folders import fresh_folder
from ..sources.repos import newer, next_watermarks, write_index
from ._base import Tables, query
from .searching import documents
from .series import items, versions

_RANKED = "SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS num FROM orders"
_ITEMS = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions FROM lineitem GROUP BY 1, 2"


@query(f"""WITH i AS ({_ITEMS}), t AS (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'other' ELSE 'patch' END AS kind FROM i WHERE l_orderkey % 4 <> 3),
s AS (SELECT l_orderkey, l_linenumber, part + 1 AS part, additions + 1000 AS additions, CASE WHEN l_orderkey % 2 = 0 THEN 9 END AS total, CASE WHEN l_orderkey % 3 = 0 THEN 'cover' ELSE 'patch' END AS kind, l_orderkey % 5 <> 0 AS has_diff, CASE WHEN l_linenumber % 2 = 0 THEN 'new' || part END AS patch FROM i WHERE l_orderkey % 4 <> 0),
b AS (SELECT coalesce(t.l_orderkey, s.l_orderkey) AS version_id, coalesce(t.l_linenumber, s.l_linenumber) AS ordinal, t.l_orderkey IS NOT NULL AS has_t, s.l_orderkey IS NOT NULL AS has_s, t.part AS tp, s.part AS sp, t.additions AS ta, s.additions AS sa, s.total AS st, t.kind AS tk, s.kind AS sk, s.has_diff AS sd, s.patch AS spatch,
coalesce(t.kind = 'patch' AND (s.kind <> 'patch' OR NOT s.has_diff), false) AS kept FROM t FULL JOIN s ON t.l_orderkey = s.l_orderkey AND t.l_linenumber = s.l_linenumber)
SELECT version_id, ordinal, CASE WHEN has_t THEN coalesce(st, 7) ELSE st END AS total, CASE WHEN kept OR NOT has_s THEN tp ELSE sp END AS message_pk, CASE WHEN kept OR NOT has_s THEN ta ELSE sa END AS additions, CASE WHEN kept OR NOT has_s THEN tk ELSE sk END AS item_type, CASE WHEN kept OR NOT has_s THEN true ELSE sd END AS has_diff,
CASE WHEN kept OR NOT has_s THEN 'old' || tp ELSE coalesce(spatch, 'old' || tp) END AS patch_id_stable FROM b""")
def item_upsert(t: Tables) -> DataFrame:
    """M5: patches are protected from mails that are none or have no diff."""
    i, k, n = items(t), F.col("l_orderkey"), F.col("l_linenumber")
    old = i.where(k % 4 != 3).select(k.alias("version_id"), n.alias("ordinal"), F.lit(7).alias("total"), F.col("part").alias("message_pk"), "additions", F.when(n % 3 == 0, "other").otherwise("patch").alias("item_type"), F.lit(True).alias("has_diff"), F.concat(F.lit("old"), F.col("part").cast("string")).alias("patch_id_stable"))
    new = i.where(k % 4 != 0).select(k.alias("version_id"), n.alias("ordinal"), F.when(k % 2 == 0, 9).alias("total"), (F.col("part") + 1).alias("message_pk"), (F.col("additions") + 1000).alias("additions"), F.when(k % 3 == 0, "cover").otherwise("patch").alias("item_type"), (k % 5 != 0).alias("has_diff"), F.when(n % 2 == 0, F.concat(F.lit("new"), F.col("part").cast("string"))).alias("patch_id_stable"))
    return upsert_items(old, new)


@query("""WITH o AS (SELECT l_orderkey AS item_id, l_partkey AS commit_oid, max(l_linenumber) AS m, l_partkey = min(min(l_partkey)) OVER (PARTITION BY l_orderkey) AS c FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), n AS (SELECT l_orderkey AS item_id, max(l_partkey) AS commit_oid FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1)
SELECT coalesce(o.item_id, n.item_id) AS item_id, coalesce(o.commit_oid, n.commit_oid) AS commit_oid, CASE WHEN n.item_id IS NOT NULL THEN 'patch_id' ELSE 'link' || o.m END AS match_method, CASE WHEN n.item_id IS NOT NULL THEN true ELSE o.c AND o.item_id NOT IN (SELECT item_id FROM n) END AS is_canonical
FROM o FULL JOIN n ON o.item_id = n.item_id AND o.commit_oid = n.commit_oid""")
def canonical_matches(t: Tables) -> DataFrame:
    """Every third order gets a new canonical commit, and its former ones stay as others."""
    key = [F.col("l_orderkey").alias("item_id"), F.col("l_partkey").alias("commit_oid")]
    rows = t.lineitem.where("l_linenumber <= 4").groupBy(*key).agg(F.max("l_linenumber").alias("m"))
    first = rows.groupBy("item_id").agg(F.min("commit_oid").alias("_first"))
    old = rows.join(first, "item_id").select("item_id", "commit_oid", F.concat(F.lit("link"), F.col("m").cast("string")).alias("match_method"), (F.col("commit_oid") == F.col("_first")).alias("is_canonical"))
    new = t.lineitem.where("l_orderkey % 3 = 0").groupBy(key[0]).agg(F.max("l_partkey").alias("commit_oid")).withColumn("match_method", F.lit("patch_id"))
    return replace_canonical(old, new)


@query("""WITH c AS (SELECT user_id AS list_id, event_type AS repo_key, ts, sha1(CAST(event_id AS VARCHAR)) AS oid FROM events), a AS (SELECT list_id, repo_key, max(ts) AS seen FROM c WHERE ts < TIMESTAMP '2024-01-10' GROUP BY 1, 2),
n AS (SELECT c.* FROM c LEFT JOIN a USING (list_id, repo_key) WHERE seen IS NULL OR ts > seen), w AS (SELECT list_id, repo_key, max(ts) AS at, arg_max(oid, (ts, oid)) AS oid FROM c GROUP BY 1, 2)
SELECT w.list_id, w.repo_key, CASE WHEN w.repo_key <> 'error' THEN w.at END AS committed_at, CASE WHEN w.repo_key <> 'error' THEN w.oid END AS last_indexed_commit_oid, (SELECT count(*) FROM n WHERE n.list_id = w.list_id AND n.repo_key = w.repo_key) AS fresh FROM w""")
def repo_watermarks(t: Tables) -> DataFrame:
    """Two scans of commits, the second of what is newer; watermarks that move on and one kind that is reset."""
    e = t.events.select(F.col("user_id").alias("list_id"), F.col("event_type").alias("repo_key"), F.sha1(F.col("event_id").cast("string")).alias("commit_oid"), F.col("ts").alias("committed_at"))
    first = next_watermarks(e.where("committed_at < timestamp_ntz '2024-01-10'"))
    fresh = newer(e, first)
    after = advanced(first, next_watermarks(fresh), reset=e.where("repo_key = 'error'").select("list_id", "repo_key"))
    return after.join(fresh.groupBy("list_id", "repo_key").agg(F.count("*").alias("n")), ["list_id", "repo_key"], "left").select("list_id", "repo_key", "committed_at", "last_indexed_commit_oid", F.coalesce("n", F.lit(0)).alias("fresh"))


@query("""WITH v AS (SELECT o_orderkey AS version_id, coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey + 1 END) AS anchor FROM orders),
m AS (SELECT event_id AS anchor, min(u) AS a, max(u) AS b FROM (SELECT event_id, user_id AS u FROM events WHERE event_type = 'click' AND event_id % 4 <> 0 UNION ALL SELECT event_id, user_id + 100 FROM events WHERE event_type = 'click' AND event_id % 3 = 0) GROUP BY 1)
SELECT version_id, v.anchor, CASE WHEN v.anchor IS NULL THEN 'no_anchor' WHEN a IS NULL THEN 'missing' WHEN a <> b THEN 'duplicate' ELSE 'found' END AS status, CASE WHEN a = b THEN a END AS thread_id FROM v LEFT JOIN m ON m.anchor = v.anchor
WHERE v.anchor IS NULL OR v.anchor IN (SELECT event_id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-27')""")
def thread_ref_backfill(t: Tables) -> DataFrame:
    """Versions whose anchors a list got in a window, and the one thread of each."""
    k, e = F.col("o_orderkey"), t.events.select(F.col("event_type").alias("list_id"), F.col("event_id").alias("message_pk"), F.col("ts").alias("seen_at"), "user_id")
    v = t.orders.select(k.alias("version_id"), F.when(k % 5 != 0, k).alias("cover_message_pk"), F.when(k % 7 != 0, k + 1).alias("first_patch_message_pk"))
    members = e.where("message_pk % 4 <> 0").select("list_id", "message_pk", F.col("user_id").alias("thread_id")).unionByName(e.where("message_pk % 3 = 0").select("list_id", "message_pk", (F.col("user_id") + 100).alias("thread_id")))
    at = lambda day: F.expr(f"timestamp_ntz '{day}'")
    return thread_refs(v, e.select("list_id", "message_pk", "seen_at"), members, "click", at("2024-01-03"), at("2024-01-27"))


_LISTS = "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS lists FROM orders GROUP BY 1"


@query(f"""WITH v AS ({_RANKED}), i AS ({_ITEMS}), p AS (SELECT l_orderkey, l_linenumber, array_to_string(list_sort(list(DISTINCT 'f' || l_partkey)), ',') AS paths FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
SELECT i.l_orderkey * 10 + i.l_linenumber AS id, 'item ' || i.part AS subject, CASE WHEN i.part % 2 = 0 THEN 'fix ' || i.part ELSE 'item ' || i.part END AS snippet, lists, coalesce(paths, '') AS file_paths, v.o_custkey AS series_id, CAST(v.num AS INTEGER) AS version_num, CAST(epoch(v.o_orderdate) AS BIGINT) AS date_ts, CAST(year(v.o_orderdate) AS INTEGER) AS year,
CAST(least(60000, i.additions * 200) AS BIGINT) AS diff_chars, c_mktsegment AS author_email FROM i JOIN v ON o_orderkey = i.l_orderkey JOIN customer ON c_custkey = v.o_custkey JOIN ({_LISTS}) l ON l.o_custkey = v.o_custkey LEFT JOIN p ON p.l_orderkey = i.l_orderkey AND p.l_linenumber = i.l_linenumber""")
def search_item_documents(t: Tables) -> DataFrame:
    """Documents of patches, with their files and the lists of their series."""
    i = items(t).withColumn("item_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    part = F.col("part").cast("string")
    of_items = i.select("item_id", F.col("l_orderkey").alias("version_id"), F.col("item_id").alias("message_pk"), F.col("l_linenumber").alias("ordinal"), F.concat(F.lit("item "), part).alias("subject"), F.when(F.col("part") % 2 == 0, F.concat(F.lit("fix "), part)).alias("commit_subject"), F.lit(True).alias("has_diff"))
    of_versions = versions(t).select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("series_id"), F.col("num").cast("int").alias("version_num"), F.lit(False).alias("is_rfc"), F.col("o_orderdate").alias("sent_at"))
    messages = i.select(F.col("item_id").alias("message_pk"), F.concat(F.col("item_id").cast("string"), F.lit("@x")).alias("message_id_primary"), F.repeat(F.lit("+" * 200), F.col("additions").cast("int")).alias("diff_text"))
    files = t.lineitem.where("l_returnflag <> 'N'").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("new_path"))
    docs = patch_item_documents(of_items, of_versions, t.customer.select(F.col("c_custkey").alias("series_id"), F.col("c_mktsegment").alias("author_email")), messages, files, t.orders.select(F.col("o_custkey").alias("series_id"), F.col("o_orderpriority").alias("list_key")))
    return docs.select("id", "subject", "snippet", F.array_join("list_keys", ",").alias("lists"), F.array_join("file_paths", ",").alias("file_paths"), "series_id", "version_num", "date_ts", "year", F.char_length("diff_search").cast("long").alias("diff_chars"), "author_email")


@query(f"""SELECT c_custkey AS series_id, CAST(coalesce(num, 1) AS INTEGER) AS latest_version_num, o_orderkey AS latest_version_id, coalesce(o_orderkey % 3 = 0, false) AS is_rfc_latest, c_acctbal > 0 AS is_merged FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY num DESC) AS rn FROM ({_RANKED})) v ON v.o_custkey = c_custkey AND rn = 1""")
def series_metadata_documents(t: Tables) -> DataFrame:
    """What changes of a series without a new document; series without versions count as of one."""
    latest = versions(t).groupBy("o_custkey").agg(F.max_by("o_orderkey", "num").alias("latest_version_id"))
    s = t.customer.join(latest, F.col("c_custkey") == F.col("o_custkey"), "left")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("merged_in_tag", "merged_in_release", "merged_commit_id")]
    series = s.select(F.col("c_custkey").alias("series_id"), "latest_version_id", F.when(F.col("c_acctbal") > 0, "merged").otherwise("unmerged").alias("merge_state"), F.lit(None).cast("long").alias("merged_version_id"), *nothing)
    return series_metadata(series, versions(t).select(F.col("o_orderkey").alias("version_id"), F.col("num").cast("int").alias("version_num"), (F.col("o_orderkey") % 3 == 0).alias("is_rfc"))).select("series_id", "latest_version_num", "latest_version_id", "is_rfc_latest", "is_merged")


@query("""WITH c AS (SELECT conv_id, count(*) AS n, arg_min(coalesce(role, ''), (turn, role)) AS starter FROM conversations GROUP BY 1) SELECT conv_id AS thread_id, CASE WHEN conv_id % 3 = 0 THEN n ELSE conv_id END AS message_count, CASE WHEN conv_id % 2 = 0 AND conv_id % 3 <> 0 THEN 'known' ELSE starter END AS starter_name FROM c""")
def hits_backfilled(t: Tables) -> DataFrame:
    """Hits that lack fields get them from the threads' metadata; a field that a hit has stays."""
    per = t.conversations.groupBy("conv_id").agg(F.count("*").alias("message_count"), F.min_by(F.coalesce("role", F.lit("")), F.struct("turn", "role")).alias("from_name"))
    nothing = F.lit(None).cast("timestamp")
    threads = per.select(F.col("conv_id").alias("thread_id"), F.lit("l").alias("list_key"), nothing.alias("created_at"), nothing.alias("last_activity_at"), "message_count", F.col("conv_id").alias("root_message_pk"))
    metadata = thread_metadata(threads, per.select(F.col("conv_id").alias("message_pk"), "from_name", F.lit("a@x").alias("from_email")))
    k = F.col("conv_id")
    hits = t.conversations.select("conv_id").distinct().select(k.alias("thread_id"), F.when(k % 3 != 0, k).alias("message_count"), F.when((k % 2 == 0) & (k % 3 != 0), "known").alias("starter_name"))
    return backfilled(hits, metadata, "thread_id", ["message_count", "starter_name"])


_HIT = "list_contains(['and', 'und'], regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g'))"


@query(rf"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents), f AS (SELECT *, coalesce(list_position(list_transform(w, lambda x: {_HIT.format("x")}), true), 0) AS f FROM w), s AS (SELECT *, greatest(0, least(f - 1 - 12, len(w) - 24)) AS s FROM f)
SELECT doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || array_to_string(list_transform(w[s + 1:s + 24], lambda x: CASE WHEN {_HIT.format("x")} THEN '<em>' || x || '</em>' ELSE x END), ' ') || CASE WHEN s + 24 < len(w) THEN '...' ELSE '' END AS cropped FROM s""")
def highlighted_crops(t: Tables) -> DataFrame:
    """Q10: twenty-four words around the first hit of each text, hits marked."""
    return t.documents.select("doc_id", cropped(F.col("text"), "and UND", 24).alias("cropped"))


@query("""SELECT 'thread-' || d.doc_id AS doc_id, d.doc_id % 2 = 0 AS has_diff, d.doc_id AS date_ts, md5(coalesce(d.text, '')) AS text_md5, len(e.embedding) AS dimensions, count(*) OVER () AS documents, count(e.vec_id) OVER () AS with_vector, '{"ranking": ["words"]}' AS settings FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id AND e.label <> 0""")
def written_index(t: Tables) -> DataFrame:
    """Documents and vectors written as JSON lines, settings last, and read again beside the counts."""
    path = fresh_folder(t.spark)
    vectors = t.embeddings.where("label <> 0").select(F.concat(F.lit("thread-"), F.col("vec_id").cast("string")).alias("doc_id"), "embedding")
    counts = write_index(documents(t), vectors, path, {"ranking": ["words"]})
    read = t.spark.read.schema("doc_id string, has_diff boolean, date_ts long, snippet_corpus string, embedding array<float>").json(f"{path}/documents")
    both = read.crossJoin(counts.select("documents", "with_vector")).crossJoin(t.spark.read.text(f"{path}/settings").select(F.col("value").alias("settings")))  # one row each
    return both.select("doc_id", "has_diff", "date_ts", F.md5("snippet_corpus").alias("text_md5"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).cast("long").alias("dimensions"), "documents", "with_vector", "settings")
