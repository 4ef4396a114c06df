"""Connected components over links between 64-bit keys.

Every round each key takes the smallest label among itself and its neighbours,
then the label of that label (pointer jumping), so a chain of n keys needs about
log n rounds. Labels of a round are written to the shared folder; the loop ends
when a round changes nothing. Only a change count reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, scratch


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> one row (node, label): label is the smallest node reachable.

    No links: no rows. Self links and repeated links do no harm.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("peer"))
    edges = scratch(both.unionByName(both.select(F.col("peer").alias("node"), F.col("node").alias("peer"))),
                    "cc-edges")
    labels = scratch(edges.groupBy("node").agg(F.least(F.min("peer"), F.col("node")).alias("label")), "cc-labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("peer"), F.col("label").alias("peer_label")), "peer") \
            .groupBy("node").agg(F.min("peer_label").alias("near"))
        lower = labels.join(seen, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jumped = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("jump")), "label") \
            .select("node", "old", F.least("label", "jump").alias("label"))
        new = scratch(jumped.select("node", "label", (F.col("old") != F.col("label")).alias("moved")), "cc-labels")
        moved = new.where("moved").limit(1).count()
        drop_scratch(labels)
        labels = new
        if not moved:
            drop_scratch(edges)
            return labels.select("node", "label")
