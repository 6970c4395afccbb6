"""Connected components of link tables, by labels that spread and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import staged


def components(edges: DataFrame) -> DataFrame:
    """id and component_id (smallest id of the component), for the ends of edges (a, b longs).

    Each round takes the smallest label among neighbours, then that label's own label, so
    long chains halve; hubs are aggregated before they are shuffled. Rounds end when no label
    changes. Labels are tables in the shared folder, so no round depends on older ones.
    """
    pairs = edges.where("a <> b").select("a", "b")
    both = staged(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("_m")).select("id", F.least("id", "_m").alias("component_id")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component_id"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("_near"))
        took = labels.join(near, "id").select("id", F.col("component_id").alias("_old"), F.least("component_id", "_near").alias("_to"))
        jump = labels.select(F.col("id").alias("_to"), F.col("component_id").alias("_further"))
        new = staged(took.join(jump, "_to", "left").select("id", "_old", F.least("_to", "_further").alias("component_id")), "labels")
        labels = new.select("id", "component_id")
        if new.where("component_id <> _old").isEmpty():
            return labels
