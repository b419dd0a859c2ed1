"""Connected components by smallest labels with pointer jumping; each round is a written table, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docpipe.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges a, b: the smallest node it is connected to. Empty edges give no rows, repeated
    edges and loops change nothing."""
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"))
    while True:
        sent = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        least = sent.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        root = least.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = materialize(least.join(root, "label").select("node", F.col("root").alias("label")), "labels")
        if new.join(labels.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty():
            return new
        labels = new
