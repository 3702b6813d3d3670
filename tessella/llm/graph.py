"""Connected components of an edge table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """edges (a, b) of longs to (node, root): the least node of each component. Every round takes the least root among neighbours
    and then the root's own root, and is written to the shared folder; it ends when a round changes nothing."""
    both = common.materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root"))
        step = common.materialise(step, "labels")
        labels = step.select("node", "root")
        if step.where("old <> root").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")
