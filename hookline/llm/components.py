"""Connected components of an edge table by smallest-label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each end of the edges (a, b); the label is the component's smallest node.

    Each round is a join of the edges with the labels and a partial minimum, so
    a node with very many edges stays spread over tasks (Spark splits a skewed
    join side). Labels are checkpointed every round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")).checkpoint()
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("at")).agg(F.min("label").alias("m")))
        spread = labels.join(near, labels["node"] == near["at"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        further = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
        jumped = (spread.join(further, spread["label"] == further["via"], "left")
                  .select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")).checkpoint())
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
