"""Connected components over an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.llm.common import drop_table, stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (u, v); the label is the smallest node reachable.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so a
    chain shrinks geometrically. Rounds are written tables: nothing is collected but a count of changes.
    A hub's edges are combined in the map tasks before they are shuffled.
    """
    both = stage_table(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = stage_table(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.min("u")).alias("label")), "labels")
    while True:
        of = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        near = both.join(of, F.col("v") == F.col("_n")).groupBy("u").agg(F.min("_l").alias("_near"))
        step = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("label").alias("_was"), F.least("label", "_near").alias("_new"))
        jump = step.join(of, F.col("_new") == F.col("_n"), "left").select("node", "_was", F.least("_new", F.coalesce("_l", "_new")).alias("label"))
        after = stage_table(jump, "labels")
        changed = after.where(F.col("label") != F.col("_was")).limit(1).count()
        drop_table(labels)
        labels = after.select("node", "label")
        if not changed:
            drop_table(both)
            return labels
