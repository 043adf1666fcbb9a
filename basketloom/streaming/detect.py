"""Detection and counting over streams.

Detection of known modules in a basket depends on the basket alone, so the batch operator's predicate works on a
stream; the module table is static and indexed by an anchor gene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.operators.filters import sized
from basketloom.sources.clusters import parse_line


def read_cluster_stream(spark: SparkSession, path: str) -> DataFrame:
    """(bgc_id, genes) of cluster files as they arrive in a folder."""
    bgc_id, genes = parse_line(F.regexp_replace("value", r"^\s+|\s+$", ""))
    return spark.readStream.text(path).filter("trim(value) != ''").select(bgc_id.alias("bgc_id"), genes.alias("genes"))


def detect_stream(clusters: DataFrame, modules: DataFrame) -> DataFrame:
    """(bgc_id, module_id, genes) of the modules in each arriving basket."""
    anchored = modules.select("module_id", F.col("genes").alias("module"), F.get("genes", F.lit(0)).alias("gene"))
    held = F.array_distinct("genes")
    met = clusters.select("bgc_id", held.alias("held"), F.explode(held).alias("gene")).join(sized(anchored), "gene")
    return met.filter(F.forall("module", lambda g: F.array_contains("held", g))).select("bgc_id", "module_id", F.col("module").alias("genes"))


def gene_counts_by_window(events: DataFrame, time: str = "ts", gene: str = "gene", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, gene, n) in tumbling windows, with a watermark for late events."""
    counts = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), gene).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), gene, "n")
