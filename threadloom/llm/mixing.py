"""Mixing sources to target weights by weighted fair queueing.

Documents of a source stand in a shuffled order that depends on a seed and the id alone.
An entry is a document in one pass over its source; its virtual finish time is the tokens
of the source up to it, over all passes, divided by the source's weight. It is taken at the
document's middle word, so that the cut, which no document is split by, rounds to the nearer
side and favours no source. Entries are ordered by it and cut where their tokens reach the budget.

No source is ever in one task: running totals are taken within (source, range of the
shuffle hash), and the totals of those ranges are carried on in a second, small sum. The
cut works alike: totals by range of finish time, then only the range it falls into is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import WORD, staged

#: Rows that a range of the shuffle hash holds on average, and ranges of virtual time.
RANGE_ROWS, TIME_RANGES = 256, 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(totals: DataFrame, share: float, passes: int) -> DataFrame:
    """Water filling over (_w weight, _total size): adds _target = min(passes * _total,
    _w * level), with the level at which the targets add up to share * sum(_total)."""
    by = Window.orderBy("_full", "_sk")
    filled = (
        totals.withColumn("_full", passes * F.col("_total") / F.col("_w"))
        .withColumn("_rest", share * F.sum("_total").over(Window.partitionBy()) - F.coalesce(F.sum(passes * F.col("_total")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_level", F.col("_rest") / F.sum("_w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_cut", F.max(F.when(F.col("_level") <= F.col("_full"), F.col("_level"))).over(Window.partitionBy()))
    )
    return filled.withColumn("_target", F.least(passes * F.col("_total").cast("double"), F.coalesce(F.col("_w") * F.col("_cut"), passes * F.col("_total").cast("double")))).drop("_full", "_rest", "_level", "_cut")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, passes: int = 2, seed: int = 17) -> DataFrame:
    """One row for each input row: id_col, source_col, size, source_size, target, times (how
    often the mix holds the document, 0 to passes) and taken (times * size).

    Sources are put in code point order, null last, and get the weights in turn, repeating.
    Every row counts, repeated rows too. Null or empty texts have size 0 and take nothing;
    a null source is a source; a null id only affects the shuffle. An empty table gives an
    empty result. Other columns are ignored, so their names can't clash.
    The mix's order is that of virtual finish times; a document that the cut goes through
    stays if at least half of it lies before the cut.
    """
    sk = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string")))
    sized = staged(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), sk.alias("_sk"), word_count(F.col(text_col)).alias("_size")), "mix-sizes")
    bits = min(20, max(0, math.ceil(math.log2(max(1, sized.count()) / RANGE_ROWS))))
    rows = sized.withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_size")).withColumn("_range", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))

    ranges = rows.groupBy("_sk", "_range").agg(F.sum("_size").alias("_in"))
    before = ranges.select("_sk", "_range", (F.sum("_in").over(Window.partitionBy("_sk").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).alias("_before"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy("_sk")) - 1) % len(weights) + 1).cast("int"))
    sources = staged(fill_targets(ranges.groupBy("_sk").agg(F.sum("_in").alias("_total")).withColumn("_w", weight), share, passes), "mix-sources")

    within = Window.partitionBy("_sk", "_range").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, 0)
    queued = rows.withColumn("_cum", F.sum("_size").over(within)).join(before, ["_sk", "_range"]).withColumn("_cum", F.col("_cum") + F.col("_before"))
    queued = staged(queued.join(sources, "_sk").select("_id", "_source", "_size", "_cum", "_total", "_w", "_target"), "mix-queue")

    finish = lambda k: (F.col("_cum") + k * F.col("_total") - 0.5 * F.col("_size")) / F.col("_w")
    cut = _cut(queued, finish, share, passes)
    times = sum(((finish(k) <= F.col("_at")).cast("int") for k in range(1, passes)), (finish(0) <= F.col("_at")).cast("int"))
    return (
        queued.crossJoin(F.broadcast(cut))  # cut is one row
        .withColumn("times", F.when(F.col("_size") > 0, times).otherwise(0))
        .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), "times", (F.col("times") * F.col("_size")).alias("taken"))
    )


def _cut(queued: DataFrame, finish, share: float, passes: int) -> DataFrame:
    """One row, _at: the finish time at which the entries' tokens reach the budget."""
    entries = queued.where("_size > 0").select("_size", "_total", "_w", "_cum", F.explode(F.array(*[finish(k) for k in range(passes)])).alias("_finish"))
    end, whole = queued.agg(F.max(passes * F.col("_total") / F.col("_w")).alias("e"), F.sum("_size").alias("s")).first()
    end, budget = float(end or 1.0) or 1.0, share * float(whole or 0)
    entries = entries.select("_size", "_finish", F.least(F.floor(F.col("_finish") / end * TIME_RANGES), F.lit(TIME_RANGES - 1)).alias("_slot"))
    slots = entries.groupBy("_slot").agg(F.sum("_size").alias("_in"))
    running = slots.withColumn("_upto", F.sum("_in").over(Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, 0)))
    hit = running.where(F.col("_upto") >= budget).agg(F.min(F.struct("_slot", (F.col("_upto") - F.col("_in")).alias("_from"))).alias("_x")).select("_x.*").where("_slot is not null")
    inside = entries.join(F.broadcast(hit), "_slot")  # one row
    run = inside.withColumn("_run", F.col("_from") + F.sum("_size").over(Window.orderBy("_finish", "_size").rowsBetween(Window.unboundedPreceding, 0)))
    return run.agg(F.coalesce(F.min(F.when(F.col("_run") >= budget, F.col("_finish"))), F.lit(end)).alias("_at"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as the mix holds it, with docs' own columns.

    Rows with one id, source and size stand side by side in the queue. Where the cut falls among
    them, as many rows as the plan says are taken each number of times, whichever they are. Null ids,
    sources and texts are as in mix_sources; an empty table gives no rows; columns' names can't clash.
    """
    id_col = options.get("id_col", "doc_id")
    source_col, text_col, passes = options.get("source_col", "source"), options.get("text_col", "text"), options.get("passes", 2)
    key = ["_mid", "_msource", "_msize"]
    plan = mix_sources(docs, **options).select(F.col(id_col).alias("_mid"), F.col(source_col).alias("_msource"), F.col("size").alias("_msize"), "times")
    upto = [F.count(F.when(F.col("times") >= k, 1)).alias(f"_upto{k}") for k in range(passes, 0, -1)]
    plan = staged(plan.groupBy(*key).agg(F.min("times").alias("_low"), F.max("times").alias("_high"), *upto).where("_high > 0"), "mix-plan")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_i"), F.col(source_col).alias("_s"), word_count(F.col(text_col)).alias("_n"))
    on = F.col("_i").eqNullSafe(F.col("_mid")) & F.col("_s").eqNullSafe(F.col("_msource")) & (F.col("_n") == F.col("_msize"))
    rows = rows.join(plan.hint("shuffle_hash"), on)
    repeated = lambda df, times: df.select("_row", F.explode(F.array_repeat(F.lit(0), times)).alias("_copy")).select("_row.*")
    taken = repeated(rows.where("_low = _high"), F.col("_high").cast("int"))
    cut = staged(rows.where("_low < _high").withColumn("_part", F.spark_partition_id()), "mix-cut")
    if cut.isEmpty():
        return taken
    # Numbers within a part, and after those of the parts before: a group is never in one task for its rows.
    parts = cut.groupBy(*key, "_part").agg(F.count("*").alias("_in"))
    before = parts.withColumn("_from", F.sum("_in").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in")).drop("_in")
    numbered = cut.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.lit(0)))).join(before.select(*(F.col(c).alias(f"_b{c}") for c in key), F.col("_part").alias("_bpart"), "_from"), F.col("_mid").eqNullSafe(F.col("_b_mid")) & F.col("_msource").eqNullSafe(F.col("_b_msource")) & (F.col("_msize") == F.col("_b_msize")) & (F.col("_part") == F.col("_bpart")))
    times = sum(((F.col("_nth") + F.col("_from") <= F.col(f"_upto{k}")).cast("int") for k in range(1, passes + 1)), F.lit(0))
    return taken.unionByName(repeated(numbered, times))
