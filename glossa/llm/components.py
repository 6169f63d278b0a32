"""Connected components by rounds of least labels and label jumps, all in joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the least node that each node of ``edges`` (a, b) reaches.

    Edges with a null end and those from a node to itself count for nothing; no edges
    give an empty table.  Each round every node takes the least label around it and then its label's own
    label, so chains shorten by halves.  Rounds are written to the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "component-edges")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "component-labels")
    previous = labels
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = labels.join(around, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        roots = labels.select(F.col("node").alias("low"), F.col("label").alias("root"))
        new = stage(low.join(roots, "low", "left").select("node", "old", F.least("low", "root").alias("label")), "component-labels")
        discard(previous)
        previous, labels = new, new.select("node", "label")
        if new.where("label <> old").isEmpty():
            discard(both)
            return labels
