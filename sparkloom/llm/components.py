"""Connected components over a table of links, without collecting any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.store import materialize, release


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the label's own
    label, so long chains shrink geometrically.  Labels and links are written tables: a lost
    executor costs one round, and a hub's rows can be split by adaptive execution.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b")
            .select(F.col("a").alias("node"), "component")
            .unionByName(labels)
            .groupBy("node")
            .agg(F.min("component").alias("component"))
        )
        near = materialize(near, "near")
        jump = labels.unionByName(near).groupBy("node").agg(F.min("component").alias("up")).select(F.col("node").alias("component"), "up")
        new = materialize(near.join(jump.hint("merge"), "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        moved = new.join(labels.withColumnRenamed("component", "old").hint("merge"), "node").where("component != old").limit(1).count()
        release(near, labels)
        labels = new
        if not moved:
            release(both)
            return labels
