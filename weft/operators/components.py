"""Connected components by least-label propagation with path halving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any orderable type -> (node, label): the least node of each component. Loops do not count.

    Each round a node takes the least label around it, and then its label's label, so paths halve. A node with very
    many edges is a hot join key on one side only, which adaptive execution splits; minima are taken before the shuffle."""
    both = edges.where("u <> v").select("u", "v")
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        best = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = best.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        step = cut(best.join(up, "label").select("node", "old", F.least("label", "higher").alias("label")))
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
