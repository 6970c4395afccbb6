"""Threads: conversations stand for threads, turns for their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import sort_key
from ..functions.text import ascii_lower, safe_prefix
from ..operators.components import closure
from ..operators.relational import has_flag, newest
from ..operators.threading import apply_threads, build_threads
from ._base import Tables, query


@query("SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations) WHERE rn = 1")
def thread_starters(t: Tables) -> DataFrame:
    """The first message of each thread."""
    return newest(t.conversations, ["conv_id"], [F.asc("turn"), F.asc("role")]).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("SELECT conv_id, role_key, turn FROM (SELECT conv_id, lower(role) AS role_key, turn, row_number() OVER (PARTITION BY conv_id, lower(role) ORDER BY turn DESC NULLS LAST) AS rn FROM conversations) WHERE rn = 1")
def thread_latest_by_author(t: Tables) -> DataFrame:
    """Each author's latest message in a thread."""
    rows = t.conversations.withColumn("role_key", F.lower("role"))
    return newest(rows, ["conv_id", "role_key"], [F.desc_nulls_last("turn")]).select("conv_id", "role_key", "turn")


@query("SELECT conv_id, role FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY role) AS rn FROM (SELECT DISTINCT conv_id, role FROM conversations)) WHERE rn <= 8")
def thread_participants(t: Tables) -> DataFrame:
    """The first eight participants of each thread."""
    return newest(t.conversations.select("conv_id", "role").distinct(), ["conv_id"], [F.asc("role")], keep=8)


@query("""SELECT conv_id, count(*) AS messages, bool_or(role = 'system') AS has_system, array_to_string(list_sort(list(DISTINCT role) FILTER (WHERE role <> 'system')), ',') AS others,
sha256(string_agg(left(coalesce(text, ''), 400), ' ' ORDER BY turn, role, text)) AS corpus_sha256 FROM conversations GROUP BY conv_id""")
def thread_summaries(t: Tables) -> DataFrame:
    """Flags, sorted sets and texts in order of a thread."""
    texts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", safe_prefix(F.col("text"), F.lit(400)).alias("p"))))
    out = t.conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.bool_or(F.col("role") == "system").alias("has_system"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("role") != "system", F.col("role")))), ",").alias("others"), texts.alias("t"))
    return out.select("conv_id", "messages", "has_system", "others", F.sha2(F.array_join(F.transform("t", lambda x: x["p"]), " "), 256).alias("corpus_sha256"))


@query("SELECT conv_id, turn FROM conversations WHERE (conv_id, turn) > (10, 1) ORDER BY conv_id, turn LIMIT 51")
def thread_page(t: Tables) -> DataFrame:
    """A page in thread order behind a cursor, and one row more."""
    here = F.struct("conv_id", "turn") > F.struct(F.lit(10).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"))
    return t.conversations.where(here).orderBy("conv_id", "turn").limit(51).select("conv_id", "turn")


@query("""SELECT conv_id, 'with' AS kind FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')
UNION ALL SELECT conv_id, 'without' FROM (SELECT DISTINCT conv_id FROM conversations) c WHERE NOT EXISTS (SELECT 1 FROM conversations s WHERE s.conv_id = c.conv_id AND s.role = 'system')""")
def threads_by_flag(t: Tables) -> DataFrame:
    """Threads with a match, and threads without one."""
    all_, system = t.conversations.select("conv_id").distinct(), t.conversations.where("role = 'system'").select("conv_id")
    return has_flag(all_, system, "conv_id", True).withColumn("kind", F.lit("with")).unionByName(has_flag(all_, system, "conv_id", False).withColumn("kind", F.lit("without")))


@query("SELECT conv_id, turn, lower(hex(conv_id)) AS conv_hex, repeat('0', 8 - len(hex(turn))) || hex(turn) || repeat('0', 8 - len(hex(turn + 1))) || hex(turn + 1) AS key_hex FROM conversations")
def sort_keys(t: Tables) -> DataFrame:
    """a path of ranks as big-endian bytes, and lower-case hex."""
    return t.conversations.select("conv_id", "turn", F.lower(F.hex("conv_id")).alias("conv_hex"), F.hex(sort_key(F.array("turn", F.col("turn") + 1))).alias("key_hex"))


def turn_messages(t: Tables) -> DataFrame:
    """Turns as messages: each refers to the one before it in its conversation, by its place there."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = t.conversations.withColumn("n", place)
    name = lambda n: F.concat(F.col("conv_id").cast("string"), F.lit("."), n.cast("string"), F.lit("@example.org"))
    none = F.array().cast("array<string>")
    return c.select(
        F.lit(1).cast("long").alias("list_id"), "conv_id", "n", (F.col("conv_id") * 1000 + F.col("n")).alias("message_pk"), F.concat(F.lit("<"), name(F.col("n")), F.lit(">")).alias("message_id_primary"), F.concat(F.when(F.col("n") > 1, "Re: ").otherwise(""), F.lit("Conversation "), F.col("conv_id").cast("string")).alias("subject_raw"),
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("subject_norm"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 1000 + F.col("n")).alias("date_utc"), F.when(F.col("n") > 1, F.array(name(F.col("n") - 1))).otherwise(none).alias("references_ids"), none.alias("in_reply_to_ids"),
    )


_PLACED = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations"


@query(f"SELECT conv_id * 1000 + n AS message_pk, CASE WHEN n > 1 THEN conv_id * 1000 + n - 1 END AS parent_message_pk, CAST(n - 1 AS INTEGER) AS depth, hex(dense_rank() OVER (ORDER BY conv_id)) AS root_hex FROM ({_PLACED})")
def thread_forest(t: Tables) -> DataFrame:
    """Threads from references; each conversation is one chain."""
    nodes, _ = build_threads(turn_messages(t))
    return nodes.where("not is_dummy").select("message_pk", "parent_message_pk", "depth", F.regexp_replace(F.substring(F.hex("sort_key"), 1, 8), "^0+", "").alias("root_hex"))


@query(f"SELECT min(conv_id * 1000 + n) AS root_message_pk, count(*) AS message_count, sha256(string_agg(conv_id || '.' || n || '@example.org' || chr(10), '' ORDER BY n)) AS membership FROM ({_PLACED}) GROUP BY conv_id")
def thread_membership(t: Tables) -> DataFrame:
    """The digest of a thread's message ids in their order."""
    _, threads = build_threads(turn_messages(t))
    return threads.select("root_message_pk", F.col("message_count").cast("long").alias("message_count"), F.lower(F.hex("membership_hash")).alias("membership"))


@query(f"SELECT conv_id, count(*) AS reached FROM ({_PLACED}) GROUP BY conv_id")
def ancestor_closure(t: Tables) -> DataFrame:
    """X12, ST7: all messages above the last one of each thread, itself included."""
    m = turn_messages(t)
    key = lambda n: F.concat_ws(".", F.col("conv_id").cast("string"), n.cast("string"))
    parents = m.where("n > 1").select(key(F.col("n")).alias("node"), key(F.col("n") - 1).alias("parent"))
    last = m.groupBy("conv_id").agg(F.max("n").alias("n")).select(key(F.col("n")).alias("node"))
    return closure(last, parents).groupBy(F.split("node", r"\.")[0].cast("long").alias("conv_id")).agg(F.count("*").alias("reached"))


@query("SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'insert' WHEN conv_id % 4 = 1 THEN 'stale' WHEN conv_id % 4 = 2 THEN 'rewrite' ELSE 'unchanged' END AS action FROM (SELECT DISTINCT conv_id FROM conversations)")
def thread_apply(t: Tables) -> DataFrame:
    """M7, ST6, T3: threads to insert, to rewrite, to drop, and those whose members are the same."""
    c = t.conversations.select(F.lit(1).alias("list_id"), F.col("conv_id").cast("string").alias("root_node_key"), F.col("conv_id").alias("k")).distinct()
    old = c.where("k % 4 <> 0").withColumn("membership_hash", F.when(F.col("k") % 4 == 2, F.lit("old")).otherwise(F.lit("same")))
    return apply_threads(old, c.where("k % 4 <> 1").withColumn("membership_hash", F.lit("same"))).select(F.col("root_node_key").cast("long").alias("conv_id"), "action")


@query("SELECT role_key, count(*) AS messages, count(DISTINCT conv_id) AS threads FROM (SELECT translate(role, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS role_key, conv_id FROM conversations) GROUP BY 1")
def authors_of_threads(t: Tables) -> DataFrame:
    """Authors by their lower-cased name."""
    return t.conversations.groupBy(ascii_lower(F.col("role")).alias("role_key")).agg(F.count("*").alias("messages"), F.countDistinct("conv_id").alias("threads"))
