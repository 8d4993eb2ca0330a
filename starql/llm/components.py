"""Connected components of a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, label)`` for every node of ``edges`` (columns ``a`` and ``b``, long); the label is the least node.

    Each round gives a node the least label among its own and its neighbours', then the label of that label (pointer
    jumping), so paths shorten quickly.  Sums and minima are aggregated map-side; each round is written to the shared
    folder, so lineage stays short and nothing comes to the driver but one count."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialise(both, "edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).select(F.col("a").alias("node"), "label").union(labels.select("node", "label"))
        low = near.groupBy("node").agg(F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = low.join(up, "label", "left").select("node", F.coalesce(F.least("next", "label"), "label").alias("label"))
        new = materialise(new, "labels")
        moved = new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
