"""Series: customers stand for patch series, orders for versions, line items for patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsers import subject_udf
from ..operators.lineage import assemble, assign_series, compare, extract_versions, logical_slots
from ..operators.mainline import first_tags, mainline_commits, match_commits, series_rollup, version_rollup
from ..operators.relational import merge, newest, replaced
from ._base import Tables, query


@query("""SELECT c_mktsegment AS segment, count(*) AS items, count(DISTINCT o_orderkey) AS versions, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def series_items(t: Tables) -> DataFrame:
    """Items, versions and series in one chain; small sides are broadcast by size."""
    chain = t.lineitem.select("l_orderkey", "l_quantity").join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation.select("n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
    return chain.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("items"), F.countDistinct("o_orderkey").alias("versions"), F.sum(F.col("l_quantity").cast("long")).alias("additions"))


@query("SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT'")
def series_left_filtered(t: Tables) -> DataFrame:
    """A left join whose condition holds on the right side only, filtered before it."""
    urgent = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey", "o_orderpriority")
    return t.customer.select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def series_latest_version(t: Tables) -> DataFrame:
    """The latest version of each series."""
    return newest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


_RANKED = "SELECT o_custkey, o_orderkey, o_orderdate, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS num FROM orders"


def versions(t: Tables) -> DataFrame:
    """Orders with their number within the series."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate", F.row_number().over(by).alias("num"))


def items(t: Tables) -> DataFrame:
    """One item for each order and line number, that of the smallest part where there are several."""
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.sum(F.col("l_quantity").cast("long")).alias("additions"))


_ITEMS = "SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS additions FROM lineitem GROUP BY 1, 2"


@query(f"""WITH v AS ({_RANKED}), i AS ({_ITEMS}), a AS (SELECT o_custkey, l_linenumber, part, additions FROM v JOIN i ON l_orderkey = o_orderkey WHERE num = 1), b AS (SELECT o_custkey, l_linenumber, part, additions FROM v JOIN i ON l_orderkey = o_orderkey WHERE num = 2)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.l_linenumber, b.l_linenumber) AS l_linenumber, a.part AS v1_item, b.part AS v2_item,
CASE WHEN a.part IS NULL THEN 'added' WHEN b.part IS NULL THEN 'removed' WHEN a.part = b.part THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.l_linenumber = b.l_linenumber""")
def version_compare(t: Tables) -> DataFrame:
    """The items of the first two versions, slot by slot."""
    both = versions(t).where("num <= 2").join(items(t), F.col("o_orderkey") == F.col("l_orderkey"))
    return compare(both.where("num = 1"), both.where("num = 2"), ["o_custkey", "l_linenumber"], "part")


@query(f"""WITH v AS ({_RANKED}), i AS ({_ITEMS}), a AS (SELECT o_custkey, l_linenumber, part FROM v JOIN i ON l_orderkey = o_orderkey WHERE num = 1), b AS (SELECT o_custkey, l_linenumber, part FROM v JOIN i ON l_orderkey = o_orderkey WHERE num = 2),
c AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS k, a.part AS x, b.part AS y FROM a FULL JOIN b ON a.o_custkey = b.o_custkey AND a.l_linenumber = b.l_linenumber)
SELECT k AS o_custkey, count(*) FILTER (WHERE x = y) AS unchanged, count(*) FILTER (WHERE x <> y) AS changed, count(*) FILTER (WHERE x IS NULL) AS added, count(*) FILTER (WHERE y IS NULL) AS removed FROM c GROUP BY 1""")
def version_compare_summary(t: Tables) -> DataFrame:
    """How many slots have each status."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return version_compare(t).groupBy("o_custkey").agg(*map(count, ("unchanged", "changed", "added", "removed")))


@query(f"""WITH v AS ({_RANKED}), f AS (SELECT o_custkey, num, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM v JOIN lineitem ON l_orderkey = o_orderkey WHERE num <= 2 GROUP BY 1, 2, 3)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, coalesce(a.l_partkey, b.l_partkey) AS path, coalesce(a.n, 0) AS v1_additions, coalesce(b.n, 0) AS v2_additions, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta
FROM (SELECT * FROM f WHERE num = 1) a FULL JOIN (SELECT * FROM f WHERE num = 2) b ON a.o_custkey = b.o_custkey AND a.l_partkey = b.l_partkey""")
def version_compare_files(t: Tables) -> DataFrame:
    """The files of two versions side by side."""
    files = versions(t).where("num <= 2").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "num", F.col("l_partkey").alias("path")).agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    side = lambda n, name: files.where(F.col("num") == n).select("o_custkey", "path", F.col("n").alias(name))
    both = side(1, "a").join(side(2, "b"), ["o_custkey", "path"], "full")
    a, b = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    return both.select("o_custkey", "path", a.alias("v1_additions"), b.alias("v2_additions"), (b - a).alias("delta"))


@query(f"""WITH v AS ({_RANKED}), i AS ({_ITEMS}), s AS (SELECT v.*, CAST(unnest(range(1, 8)) AS INTEGER) AS l_linenumber FROM v), r AS (SELECT s.o_custkey, s.o_orderkey, s.num, s.l_linenumber, i.part FROM s LEFT JOIN i ON i.l_orderkey = s.o_orderkey AND i.l_linenumber = s.l_linenumber),
p AS (SELECT *, last_value(part IGNORE NULLS) OVER w AS past, last_value(CASE WHEN part IS NOT NULL THEN num END IGNORE NULLS) OVER w AS past_num FROM r WINDOW w AS (PARTITION BY o_custkey, l_linenumber ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT o_custkey, o_orderkey, num, l_linenumber, coalesce(part, past) AS part, CASE WHEN part IS NULL THEN past_num END AS inherited_from FROM p WHERE coalesce(part, past) IS NOT NULL""")
def assembled_items(t: Tables) -> DataFrame:
    """Each version's seven ordinals, with items of its own or of the greatest lower version."""
    return _assembled(t)


def _assembled(t: Tables) -> DataFrame:
    v = versions(t).withColumn("total", F.lit(7)).withColumn("num", F.col("num").cast("long"))
    return assemble(v, items(t).withColumnRenamed("l_orderkey", "o_orderkey"), "o_custkey", "o_orderkey", "num", "o_orderdate", "l_linenumber", "part")


@query(f"""WITH v AS ({_RANKED}), i AS ({_ITEMS}) SELECT o_custkey AS series_id, CAST(l_linenumber AS INTEGER) AS slot, CAST(num AS INTEGER) AS version_num, l_orderkey * 10 + l_linenumber AS item_id FROM v JOIN i ON l_orderkey = o_orderkey""")
def slots_by_ordinal(t: Tables) -> DataFrame:
    """Without patch ids and titles, the ordinal is the slot."""
    v = versions(t).join(items(t), F.col("o_orderkey") == F.col("l_orderkey"))
    return logical_slots(v.select(F.col("o_custkey").alias("series_id"), F.col("num").cast("int").alias("version_num"), F.col("l_linenumber").cast("int").alias("ordinal"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item_id"), F.lit("").alias("patch_id"), F.lit("").alias("title")))


_STATES = """SELECT l_orderkey AS version_id, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS matched, CASE WHEN count(*) FILTER (WHERE l_linestatus = 'F') = 0 THEN 'unmerged' WHEN count(*) FILTER (WHERE l_linestatus = 'F') < count(*) THEN 'partial' ELSE 'merged' END AS state,
max(CASE WHEN l_linestatus = 'F' THEN l_suppkey END) AS tag_key FROM lineitem GROUP BY 1"""


@query(f"SELECT version_id, total, matched, state, tag_key AS tag FROM ({_STATES})")
def version_merge_state(t: Tables) -> DataFrame:
    """Merge state and latest tag of each version."""
    i = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_linestatus", "l_suppkey", "l_partkey").agg(F.count("*").alias("n")).withColumn("item_id", F.xxhash64("l_orderkey", "l_linenumber", "l_linestatus", "l_suppkey", "l_partkey"))
    done = i.where("l_linestatus = 'F'").select("item_id", F.col("l_suppkey").cast("string").alias("commit_oid"), F.col("l_suppkey").alias("tag"), F.col("l_suppkey").alias("tag_key"), F.col("l_suppkey").alias("release"), F.col("l_suppkey").alias("release_key"))
    rows = i.select(F.col("l_orderkey").alias("version_id"), F.lit(1).alias("ordinal"), "item_id", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_copy")).drop("_copy")
    return version_rollup(rows, done).select("version_id", "total", "matched", "state", "tag")


@query(f"""WITH s AS ({_STATES}), r AS (SELECT o_custkey, version_id, num, state, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE state WHEN 'merged' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END DESC, CASE WHEN state = 'partial' THEN matched ELSE 0 END DESC, CASE WHEN state = 'partial' THEN total ELSE 0 END DESC, num DESC) AS rn
FROM s JOIN ({_RANKED}) ON o_orderkey = version_id) SELECT o_custkey AS series_id, version_id, CAST(num AS INTEGER) AS version_num, state FROM r WHERE rn = 1""")
def series_merge_state(t: Tables) -> DataFrame:
    """X11: the version that says whether a series was merged."""
    s = version_merge_state(t).join(versions(t), F.col("o_orderkey") == F.col("version_id"))
    return series_rollup(s.select(F.col("o_custkey").alias("series_id"), "version_id", F.col("num").alias("version_num"), F.col("o_orderdate").alias("sent_at"), "state", "total", "matched"))


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.name, a.name) AS name, least(a.first_at, b.first_at) AS first_at, greatest(a.last_at, b.last_at) AS last_at, coalesce(a.flag, false) OR coalesce(b.flag, false) AS flag, CASE WHEN a.k IS NOT NULL THEN a.kept ELSE b.kept END AS kept
FROM (SELECT o_custkey AS k, max(o_orderstatus) AS name, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, bool_or(o_orderpriority = '1-URGENT') AS flag, count(*) AS kept FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a
FULL JOIN (SELECT o_custkey AS k, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE max(o_orderstatus) END AS name, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, bool_or(o_orderpriority = '1-URGENT') AS flag, count(*) AS kept FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) b ON a.k = b.k""")
def upsert(t: Tables) -> DataFrame:
    """An upsert with a rule for each column."""
    state = lambda odd, name: t.orders.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("k")).agg(name.alias("name"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("flag"), F.count("*").alias("kept"))
    new = state(1, F.max("o_orderstatus")).withColumn("name", F.when(F.col("k") % 3 != 0, F.col("name")))
    return merge(state(0, F.max("o_orderstatus")), new, ["k"], {"name": "fill", "first_at": "least", "last_at": "greatest", "flag": "or", "kept": "keep"})


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT l_orderkey, 0, l_partkey FROM lineitem WHERE l_orderkey % 7 = 0 AND l_linenumber = 1")
def replace_children(t: Tables) -> DataFrame:
    """All rows of some parents replaced."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    new = rows.where("l_orderkey % 7 = 0 and l_linenumber = 1").withColumn("l_linenumber", F.lit(0))
    gone = t.orders.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return replaced(rows.join(gone, "l_orderkey", "left_anti").where("l_orderkey % 7 <> 0"), new, ["l_orderkey"])


@query("SELECT a.o_orderkey, b.o_orderkey AS candidate FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate >= a.o_orderdate - INTERVAL 180 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 1 DAY AND a.o_orderkey <> b.o_orderkey")
def similarity_candidates(t: Tables) -> DataFrame:
    """Other versions of the series in a closed window of time: an equi-join with a range behind it."""
    a = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    b = a.select("o_custkey", F.col("o_orderkey").alias("candidate"), F.col("o_orderdate").alias("at"))
    near = F.expr("at >= o_orderdate - interval 180 days and at <= o_orderdate + interval 1 day")
    return a.join(b, "o_custkey").where(near & (F.col("o_orderkey") != F.col("candidate"))).select("o_orderkey", "candidate")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7)")
def by_key_set(t: Tables) -> DataFrame:
    """Rows of a set of keys, as a semi join that is broadcast by size."""
    keys = t.part.where("p_size = 7").select(F.col("p_partkey").alias("l_partkey"))
    return t.lineitem.join(keys, "l_partkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INTEGER) AS ordinal, CAST(greatest(7, l_linenumber) AS INTEGER) AS total, CAST(l_orderkey % 5 + 1 AS INTEGER) AS version_num, l_orderkey % 5 = 0 AS revision_inferred, l_orderkey % 3 = 0 AS is_rfc, l_orderkey % 2 = 0 AS had_reply_prefix, l_orderkey % 11 = 0 AS is_resend,
'fix part ' || l_partkey AS subject_norm_base, CASE WHEN l_orderkey % 13 = 0 THEN 'net-next' ELSE '' END AS tags FROM lineitem""")
def patch_subjects(t: Tables) -> DataFrame:
    """Subjects of all forms, read back."""
    k = F.col("l_orderkey")
    text = F.concat(F.when(k % 2 == 0, "RE: ").otherwise(""), F.lit("["), F.when(k % 3 == 0, "RFC ").otherwise(""), F.lit("PATCH"), F.when(k % 5 != 0, F.concat(F.when(k % 4 == 0, "v").otherwise(" v"), (k % 5 + 1).cast("string"))).otherwise(""), F.when(k % 11 == 0, " RESEND").otherwise(""), F.when(k % 13 == 0, " net-next,").otherwise(""), F.lit(" "), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit("/7]  Fix   part "), F.col("l_partkey").cast("string"))
    s = t.lineitem.select(k, "l_linenumber", subject_udf(text).alias("s"))
    return s.select("l_orderkey", "l_linenumber", "s.ordinal", "s.total", "s.version_num", "s.revision_inferred", "s.is_rfc", "s.had_reply_prefix", "s.is_resend", "s.subject_norm_base", F.array_join("s.extra_tags", ",").alias("tags"))


@query("""SELECT o_orderkey AS thread_id, CAST(row_number() OVER w AS INTEGER) AS version_num, first_value(o_orderkey) OVER w AS series_thread_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def series_lineage(t: Tables) -> DataFrame:
    """Orders as mails of one thread each, whose versions refer to the one before; every customer is one series."""
    with_items = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    v = with_items.select("o_custkey", "o_orderkey", "o_orderdate", F.row_number().over(by).alias("num")).withColumn("before", F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("num")))
    i = items(t).withColumn("total", F.max("l_linenumber").over(Window.partitionBy("l_orderkey")))
    rows = v.join(i, F.col("o_orderkey") == F.col("l_orderkey"))
    name = lambda c: F.concat(F.col(c).cast("string"), F.lit("@example.org"))
    none, nothing = F.array().cast("array<string>"), F.lit(None).cast("string")
    mails = rows.select(
        F.lit(1).cast("long").alias("list_id"), F.col("o_orderkey").alias("thread_id"), F.col("l_linenumber").alias("sort_key"), (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("message_pk"), F.concat(F.col("o_orderkey").cast("string"), F.lit("@example.org")).alias("message_id_primary"),
        F.concat(F.lit("[PATCH v"), F.col("num").cast("string"), F.lit(" "), F.col("l_linenumber").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit("] part "), F.col("part").cast("string"), F.lit(" of "), F.col("o_orderkey").cast("string")).alias("subject_raw"), F.lit("A").alias("from_name"),
        F.concat(F.col("o_custkey").cast("string"), F.lit("@example.org")).alias("from_email"), F.col("o_orderdate").cast("timestamp").alias("date_utc"), F.when(F.col("before").isNotNull(), F.array(name("before"))).otherwise(none).alias("references_ids"), none.alias("in_reply_to_ids"), nothing.alias("base_commit"), nothing.alias("change_id"), F.lit(True).alias("has_diff"), F.sha1(F.concat_ws("-", "o_orderkey", "l_linenumber")).alias("patch_id_stable"),
    )
    thread = lambda c: F.split(c, "/")[1].cast("long")
    return assign_series(extract_versions(mails)).select(thread("version_key").alias("thread_id"), F.col("version_num").cast("int").alias("version_num"), thread("series_key").alias("series_thread_id"))


@query("""SELECT l_orderkey * 10 + l_linenumber AS item_id, 'c' || l_orderkey AS commit_oid, CASE WHEN l_linenumber % 2 = 0 THEN 'link' ELSE 'patch_id' END AS match_method, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey || '.' || l_linenumber || '@example.org' END AS matched_message_id
FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 <> 0 AND l_linenumber <= 2)""")
def mainline_matches(t: Tables) -> DataFrame:
    """A commit for each order that links to its second item and has the patch id of its first."""
    i = t.lineitem.where("l_linenumber <= 2").select("l_orderkey", "l_linenumber").distinct()
    mail = F.concat(F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit("@example.org"))
    pk = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    all_items = i.select(pk.alias("item_id"), pk.alias("message_pk"), F.when(F.col("l_linenumber") == 1, F.sha1(mail)).alias("patch_id"), F.lit("a fix").alias("subject"))
    second, first = F.concat(F.col("l_orderkey").cast("string"), F.lit(".2%40example.org")), F.concat(F.col("l_orderkey").cast("string"), F.lit(".1@example.org"))
    commits = i.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.min("l_linenumber").alias("m")).select(F.concat(F.lit("c"), F.col("l_orderkey").cast("string")).alias("commit_oid"), F.timestamp_seconds(F.col("l_orderkey")).alias("committed_at"), F.lit("[PATCH] A fix").alias("subject"), F.concat(F.lit("Text.\nLink: https://lore.kernel.org/list/"), second, F.lit("/\n")).alias("body"), F.sha1(first).alias("patch_id_stable"))
    return match_commits(commits, all_items, i.select(mail.alias("message_id"), pk.alias("message_pk")), all_items.where("floor(item_id / 10) % 3 = 0").select("item_id"))


@query("""SELECT 'c' || n AS commit_oid, CASE WHEN t <= mx THEN 'v1.' || (t // 20) || CASE WHEN (t // 20) % 3 = 1 THEN '-rc2' ELSE '' END END AS first_containing_tag FROM (SELECT n, CAST(ceil(n / 20.0) * 20 AS BIGINT) AS t, mx FROM (SELECT n_nationkey + 1 AS n, (SELECT max(n_nationkey) + 1 FROM nation) AS mx FROM nation))""")
def first_containing_tags(t: Tables) -> DataFrame:
    """A chain of commits with a tag at every twentieth; the first tag that reaches each."""
    n = t.nation.select((F.col("n_nationkey") + 1).alias("n"))
    commits = n.select(F.concat(F.lit("c"), F.col("n").cast("string")).alias("commit_oid"), F.when(F.col("n") > 1, F.array(F.concat(F.lit("c"), (F.col("n") - 1).cast("string")))).otherwise(F.array().cast("array<string>")).alias("parents"), F.timestamp_seconds(F.col("n")).alias("committed_at"))
    minor = F.floor(F.col("n") / 20)
    tags = n.where("n % 20 = 0").select(F.concat(F.lit("v1."), minor.cast("string"), F.when(minor % 3 == 1, "-rc2").otherwise("")).alias("tag_name"), F.concat(F.lit("c"), F.col("n").cast("string")).alias("target_oid"))
    return first_tags(mainline_commits(commits), tags).select("commit_oid", "first_containing_tag")


@query("""SELECT p_partkey, CAST(5 AS BIGINT) AS major, CAST(p_size AS BIGINT) AS minor, 5000000000 + p_size * 1000000 + (p_partkey % 4) * 1000 AS release_sort_key, 5000000000 + p_size * 1000000 + (p_partkey % 4) * 1000 + CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 9 ELSE 999 END AS tag_sort_key,
'v5.' || p_size || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '.' || (p_partkey % 4) END AS release FROM part WHERE p_size <> 13""")
def version_tag_keys(t: Tables) -> DataFrame:
    """numbers that sort tags, and the name of the release; other tags are none."""
    from ..functions.scalars import tag_parts

    k = F.col("p_partkey")
    tag = F.concat(F.when(F.col("p_size") == 13, "w5.").otherwise("v5."), F.col("p_size").cast("string"), F.when(k % 4 != 0, F.concat(F.lit("."), (k % 4).cast("string"))).otherwise(""), F.when(k % 2 == 0, F.concat(F.lit("-rc"), (k % 9).cast("string"))).otherwise(""))
    return t.part.select(k, tag_parts(tag).alias("t")).where("t is not null").select("p_partkey", "t.major", "t.minor", "t.release_sort_key", "t.tag_sort_key", "t.release")
