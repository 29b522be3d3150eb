"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.session import cut


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the smallest node reached.

    Every round takes the smallest label among the neighbours and then the
    label of that label, so long chains shrink by halves. Labels of a node
    with many neighbours are combined before the shuffle. Rounds end when no
    label moves; rows with a null end and self links are ignored, no edges
    give no rows. Labels are checkpointed, so a lost executor costs one round.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = cut(both.distinct())
    labels = cut(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    for _ in range(rounds):
        heard = (
            links.join(labels, links["b"] == labels["node"])
            .groupBy("a").agg(F.min("root").alias("best")).withColumnRenamed("a", "_node")
        )
        moved = labels.join(heard, labels["node"] == heard["_node"], "left").select(
            "node", "root", F.least("root", "best").alias("next")
        )
        jump = labels.select(F.col("node").alias("_at"), F.col("root").alias("_up"))
        new = cut(
            moved.join(jump, moved["next"] == jump["_at"], "left").select(
                "node", F.least("next", "_up").alias("root"), (F.least("next", "_up") != F.col("root")).alias("changed")
            )
        )
        labels = new.select("node", "root")
        if not new.where("changed").limit(1).count():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
