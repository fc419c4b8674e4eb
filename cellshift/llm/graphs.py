"""Connected components of a link table by repeated minima and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellshift.session import cut_lineage


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, label) with the smallest reachable node as label, for every node of a link.

    Each round takes the smallest label among a node's neighbours and then follows
    the label's own label, so chains shorten by a factor per round.  Hot nodes are
    met by partial minima and by adaptive splitting of skewed joins.  Labels are
    checkpointed each round; nothing is collected but the count of changes.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u is not null and v is not null and u <> v")
    edges = cut_lineage(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    labels = cut_lineage(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("label")))
    while True:
        heard = (
            edges.join(labels.select(F.col("node").alias("v"), F.col("label").alias("heard")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("heard").alias("heard"))
        )
        nearer = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("near"))
        hops = labels.select(F.col("node").alias("near"), F.col("label").alias("jump"))
        moved = cut_lineage(
            nearer.join(hops, "near", "left").select("node", F.col("label").alias("old"), F.least("near", F.coalesce("jump", "near")).alias("label"))
        )
        changed = moved.filter("old <> label").limit(1).count()
        labels = moved.select("node", "label")
        if not changed:
            return labels
