"""Lists: events stand for messages of a list (event_type) by an author (user_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, split_date
from ..operators.relational import between, either, newest, where_set
from ._base import NOW, Tables, query


@query("SELECT event_type, date_trunc('day', ts) AS day, count(*) AS messages, count(DISTINCT user_id) AS authors FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' GROUP BY 1, 2")
def list_activity_by_day(t: Tables) -> DataFrame:
    """Messages and authors of each list and day of a half-open window."""
    rows = t.events.where("ts >= timestamp_ntz '2024-01-05' and ts < timestamp_ntz '2024-01-25'")
    return rows.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("messages"), F.countDistinct("user_id").alias("authors"))


@query("""SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS purchases, coalesce(b.n, 0) AS errors
FROM (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1) a
FULL OUTER JOIN (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.day = b.day""")
def list_activity_full_outer(t: Tables) -> DataFrame:
    """Two daily counts side by side, days of either."""
    daily = lambda kind, name: t.events.where(F.col("event_type") == kind).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias(name))
    return daily("purchase", "purchases").join(daily("error", "errors"), "day", "full").select("day", F.coalesce("purchases", F.lit(0)).alias("purchases"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query(f"""SELECT event_type, count(*) AS messages, count(DISTINCT user_id) AS authors, min(ts) AS first_at, max(ts) AS last_at,
count(*) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS recent, count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY) AS recent_authors,
max(event_type) AS top_name FROM events GROUP BY event_type""")
def list_stats(t: Tables) -> DataFrame:
    """All statistics of a list from one grouping instead of one subquery each."""
    recent = F.col("ts") >= F.expr(f"timestamp_ntz '{NOW}' - interval 14 days")
    return t.events.groupBy("event_type").agg(F.count("*").alias("messages"), F.countDistinct("user_id").alias("authors"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_if(recent).alias("recent"), F.countDistinct(F.when(recent, F.col("user_id"))).alias("recent_authors"), F.max("event_type").alias("top_name"))


@query("SELECT user_id, count(*) AS messages, count(DISTINCT event_type) AS lists FROM events GROUP BY user_id ORDER BY messages DESC, user_id LIMIT 5")
def list_top_authors(t: Tables) -> DataFrame:
    """L1, L3: the five most active authors, ties to smaller ids."""
    return t.events.groupBy("user_id").agg(F.count("*").alias("messages"), F.countDistinct("event_type").alias("lists")).orderBy(F.desc("messages"), "user_id").limit(5)


@query("SELECT (SELECT count(*) FROM events) AS messages, (SELECT count(DISTINCT event_type) FROM events) AS lists, (SELECT count(DISTINCT user_id) FROM events) AS authors, (SELECT count(DISTINCT conv_id) FROM conversations) AS threads, (SELECT count(*) FROM documents) AS documents")
def catalog_counts(t: Tables) -> DataFrame:
    """A1, A10: many counts in one row; each is a one-row aggregate."""
    events = t.events.agg(F.count("*").alias("messages"), F.countDistinct("event_type").alias("lists"), F.countDistinct("user_id").alias("authors"))
    return events.crossJoin(t.conversations.agg(F.countDistinct("conv_id").alias("threads"))).crossJoin(t.documents.agg(F.count("*").alias("documents")))


@query("SELECT DISTINCT event_type, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-12'")
def lists_of_batch(t: Tables) -> DataFrame:
    """P4, A12, T1, ST4: what a closed ingest window touched."""
    return t.events.where("ts >= timestamp_ntz '2024-01-10' and ts <= timestamp_ntz '2024-01-12'").select("event_type", "user_id").distinct()


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'view') AND event_type <> 'view' AND user_id IS NOT DISTINCT FROM 3 AND lower(event_type) = lower('CLICK') ORDER BY event_id")
def filters_optional(t: Tables) -> DataFrame:
    """Predicates of the parameters that are set, pushed to the scan."""
    rows = where_set(t.events, user_id=3, event_type=None)
    return rows.where(F.col("event_type").isin("click", "view") & (F.col("event_type") != "view") & F.col("user_id").eqNullSafe(F.lit(3)) & (F.lower("event_type") == "click")).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END AS prio, CASE WHEN value > 50 THEN 'high' WHEN value IS NULL THEN 'none' ELSE 'low' END AS size,
coalesce(value, 0.0) AS value_or_0, greatest(value, 10.0) AS at_least, least(value, 10.0) AS at_most, CAST(user_id AS INTEGER) AS user_int, CAST(NULL AS INTEGER) AS nothing FROM events""")
def expressions(t: Tables) -> DataFrame:
    """Cases, coalesce, greatest, least, casts."""
    v, kind = F.col("value"), F.col("event_type")
    return t.events.select("event_id", F.when(kind == "error", 2).when(kind == "signup", 1).otherwise(0).alias("prio"), F.when(v > 50, "high").when(v.isNull(), "none").otherwise("low").alias("size"), F.coalesce(v, F.lit(0.0)).alias("value_or_0"), F.greatest(v, F.lit(10.0)).alias("at_least"), F.least(v, F.lit(10.0)).alias("at_most"), F.col("user_id").cast("int").alias("user_int"), F.lit(None).cast("int").alias("nothing"))


@query("SELECT event_type, count(*) FILTER (WHERE dayofweek(ts) = 0) AS sunday, count(*) FILTER (WHERE dayofweek(ts) BETWEEN 1 AND 5) AS weekday, count(*) FILTER (WHERE dayofweek(ts) = 6) AS saturday FROM events GROUP BY 1")
def queue_by_state(t: Tables) -> DataFrame:
    """Counts by state as columns."""
    day = F.dayofweek("ts")
    return t.events.groupBy("event_type").agg(F.count_if(day == 1).alias("sunday"), F.count_if(day.between(2, 6)).alias("weekday"), F.count_if(day == 7).alias("saturday"))


@query("SELECT event_id, user_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1")
def newest_of_group(t: Tables) -> DataFrame:
    """The newest row of each group, large values first."""
    order = [F.when(F.col("value") > 50, 0).otherwise(1), F.desc_nulls_last("ts"), F.desc("event_id")]
    return newest(t.events, ["user_id", "event_type"], order).select("event_id", "user_id", "event_type", "ts")


@query("SELECT event_id, ts, user_id FROM events WHERE (ts, event_id) < (TIMESTAMP '2024-01-20', 1000000) ORDER BY ts DESC, event_id DESC LIMIT 51")
def events_page(t: Tables) -> DataFrame:
    """A keyset page, newest first, and one row more."""
    here = F.struct("ts", "event_id") < F.struct(F.expr("timestamp_ntz '2024-01-20'").alias("ts"), F.lit(1_000_000).cast("long").alias("event_id"))
    return t.events.where(here).orderBy(F.desc("ts"), F.desc("event_id")).limit(51).select("event_id", "ts", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_id > 20 ORDER BY event_id LIMIT 100 OFFSET 40")
def events_offset_page(t: Tables) -> DataFrame:
    """Rows after an id, and a page by offset."""
    return t.events.where("event_id > 20").orderBy("event_id").offset(40).limit(100).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE value IS NULL OR value > 90 OR user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 95)")
def disjunctive_exists(t: Tables) -> DataFrame:
    """One condition or a match, as two branches without a disjunctive join."""
    keys = t.events.where("event_type = 'error' and value > 95").select("user_id").distinct()
    return either(t.events, F.col("value").isNull() | (F.col("value") > 90), keys, "user_id").select("event_id")


@query("SELECT a.user_id, a.event_type, a.n AS messages, b.n AS errors FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) a JOIN (SELECT user_id, event_type, count(*) AS n FROM events WHERE value > 50 GROUP BY 1, 2) b USING (user_id, event_type)")
def composite_key_join(t: Tables) -> DataFrame:
    """A join on two columns; both sides come from one grouping's partitioning."""
    count = lambda df, name: df.groupBy("user_id", "event_type").agg(F.count("*").alias(name))
    return count(t.events, "messages").join(count(t.events.where("value > 50"), "errors"), ["user_id", "event_type"])


@query("""WITH w AS (SELECT user_id, list(DISTINCT event_type) FILTER (WHERE ts < TIMESTAMP '2024-01-04') AS a, list(DISTINCT event_type) FILTER (WHERE ts >= TIMESTAMP '2024-01-28') AS b FROM events GROUP BY 1)
SELECT user_id, CASE WHEN len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) = 0 THEN 0.0 ELSE round(len(list_intersect(coalesce(a, []), coalesce(b, []))) / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), 6) END AS similarity FROM w""")
def set_similarity(t: Tables) -> DataFrame:
    """Jaccard similarity of what authors did at the start and at the end; 0 if neither."""
    early, late = F.col("ts") < F.expr("timestamp_ntz '2024-01-04'"), F.col("ts") >= F.expr("timestamp_ntz '2024-01-28'")
    sets = t.events.groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("a"), F.collect_set(F.when(late, F.col("event_type"))).alias("b"))
    return sets.select("user_id", F.round(jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'purchase') u
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 99) GROUP BY 1""")
def set_operations(t: Tables) -> DataFrame:
    """A union of ids without those in another set."""
    ids = lambda where: t.events.where(where).select("user_id")
    both = ids("event_type = 'click'").union(ids("event_type = 'purchase'")).distinct()
    return both.join(ids("event_type = 'error' and value > 99"), "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS date_utc, CAST(floor(epoch(ts)) AS BIGINT) AS date_ts, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def dates_and_json(t: Tables) -> DataFrame:
    """parts of a date in UTC, and a field of a JSON payload."""
    return t.events.select("event_id", split_date(F.col("ts")).alias("d"), F.get_json_object("props", "$.k").cast("long").alias("k")).select("event_id", "d.*", "k")


@query("SELECT event_id, CAST(least(100.0 * pow(2, event_id % 12), 5000) AS BIGINT) AS wait_ms, coalesce(ts + INTERVAL 45 SECOND < TIMESTAMP '2024-01-15 12:00:00', false) AS stuck FROM events")
def queue_backoff(t: Tables) -> DataFrame:
    """waits that double up to a limit, and leases that ran out."""
    from ..functions.scalars import backoff, is_stuck

    return t.events.select("event_id", backoff(F.lit(100), F.lit(5000), F.col("event_id") % 12 + 1).alias("wait_ms"), is_stuck(F.expr("ts + interval 45 seconds"), F.expr("timestamp_ntz '2024-01-15 12:00:00'")).alias("stuck"))


@query("SELECT event_type, n AS stored, CASE WHEN event_type = 'view' THEN 0 ELSE m END AS indexed, CASE WHEN event_type = 'view' THEN 0 ELSE m END - n AS delta FROM (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS m FROM events GROUP BY 1)")
def storage_drift(t: Tables) -> DataFrame:
    """Stored against indexed counts; what the index lacks counts as 0."""
    from ..operators.search import drift

    stored = t.events.groupBy("event_type").agg(F.count("*").alias("stored"))
    indexed = t.events.where("event_type <> 'view'").groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("indexed"))
    return drift(stored, indexed, "event_type")


@query("SELECT event_id FROM events WHERE value >= 10 AND value < 20 UNION ALL SELECT event_id FROM events WHERE value >= 30 AND value <= 40")
def ranges(t: Tables) -> DataFrame:
    """A half-open and a closed range."""
    return between(t.events, "value", 10.0, 20.0).select("event_id").unionByName(between(t.events, "value", 30.0, 40.0, closed=True).select("event_id"))
