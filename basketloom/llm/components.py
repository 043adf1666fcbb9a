"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import scratch, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node of ``links``; comp is the smallest node that it reaches.

    Nodes are non-null and comparable.  Each round takes the smallest label among a node and its neighbours,
    then the label of that label, so chains halve; labels are written out each round, which cuts the lineage.
    An empty table gives an empty result; repeated and reversed links and self-links are harmless.
    """
    with scratch(links.sparkSession) as keep:
        return keep(_labels(links, a, b))


def _labels(links: DataFrame, a: str, b: str) -> DataFrame:
    both = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(links.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).select(F.col("u").alias("node"), "comp")
        least = near.groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(least, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        far = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = written(step.join(far, "comp", "left").select("node", "old", F.least("comp", "far").alias("comp")), "labels")
        if step.filter("comp < old").isEmpty():
            return written(step.select("node", "comp"), "components")
        labels = step.select("node", "comp")
