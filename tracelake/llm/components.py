"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import common


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that it reaches.

    Nodes are of any type that has an order; links from a node to itself or to null count for nothing,
    repeated ones once, and no links give no rows.

    Each round moves every node to the smallest label around it, then to that
    label's own label, so that long chains halve.  Sums are partial and joins
    are plain equi-joins, so a component of any size is spread over tasks; the
    label table of each round is written to the shared folder.
    """
    spark = links.sparkSession
    old: list[str] = []
    edges = common.materialize(
        links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), old
    )
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
        "node", F.least("node", "low").alias("component")
    )
    held: list[str] = []
    labels = common.materialize(labels, held)
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["node"])
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        moved = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("to"))
        # A label is itself a node, and its own label is at most itself.
        own = labels.select(F.col("node").alias("to"), F.col("component").alias("own"))
        moved = moved.join(own, "to").select("node", F.least("to", "own").alias("component"), "was")
        fresh: list[str] = []
        next_labels = common.materialize(moved, fresh)
        changed = next_labels.where("component <> was").limit(1).count()
        for path in held:
            common.drop_table(spark, path)
        labels, held = next_labels.select("node", "component"), fresh
        if not changed:
            for path in old:
                common.drop_table(spark, path)
            return labels
