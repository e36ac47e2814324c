"""Connected components by minimum labels, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import remove, written


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (a, b): the smallest node it reaches.

    Each round takes the smallest label among neighbours, then that label's own label, so labels travel along stars and chains in
    a number of rounds that grows with the logarithm of their length. Rounds are written to the shared folder; a round's table goes when the next one is there. A hub with
    many edges is pre-aggregated on the map side; nothing but one changed-count a round reaches the driver. Null ends are ignored.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct()
    spark = edges.sparkSession
    both, edges_at = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, at = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("next"), "component")
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("up"))
        new = step.join(up, "next", "left").select("node", F.least("next", F.coalesce("up", "next")).alias("component"), (F.least("next", F.coalesce("up", "next")) != F.col("component")).alias("changed"))
        new, new_at = written(new, "labels")
        remove(spark, at)
        labels, at = new.select("node", "component"), new_at
        if not new.where("changed").limit(1).count():
            remove(spark, edges_at)
            return labels
