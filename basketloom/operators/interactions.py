"""How often genes are neighbours, and how often they share a basket.

Baskets come as (bgc_id, genes) with the genes of a basket in one array, so neighbours and pairs are read within a
row: the only shuffle is the one of the partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.functions.genes import EMPTY, rewritten_length


def _triples(clusters: DataFrame) -> DataFrame:
    """(p, g, n): each gene with its neighbours, null beyond the ends; baskets of two genes or more."""
    at = F.sequence(F.lit(1), F.size("genes"))
    triples = F.transform(at, lambda i: F.struct(F.get("genes", i - 2).alias("p"), F.get("genes", i - 1).alias("g"), F.get("genes", i).alias("n")))
    return clusters.filter(F.size("genes") > 1).select(F.explode(triples).alias("t")).select("t.*")


def _real(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != EMPTY)


def _between(rows: DataFrame) -> DataFrame:
    """Places whose two neighbours are the same gene."""
    return rows.filter(_real("p") & (F.col("p") == F.col("n")))


def adjacency_nodes(clusters: DataFrame) -> DataFrame:
    """(gene, cnt, n1, n2): occurrences, places next to one occurrence, and places between two.

    Each non-empty gene counts one place for each neighbour.  A place between two occurrences of the same gene is
    moved from the first kind (where it counted twice) to the second.
    """
    rows = _triples(clusters)
    sides = F.when(F.col("p").isNull() | F.col("n").isNull(), 1).otherwise(2)
    own = rows.filter(_real("g")).select(F.col("g").alias("gene"), F.lit(1).alias("cnt"), sides.alias("n1"), F.lit(0).alias("n2"))
    moved = _between(rows).select(F.col("p").alias("gene"), F.lit(0).alias("cnt"), F.lit(-2).alias("n1"), F.lit(1).alias("n2"))
    return own.unionByName(moved).groupBy("gene").agg(*(F.sum(c).cast("long").alias(c) for c in ("cnt", "n1", "n2")))


def adjacency_pairs(clusters: DataFrame) -> DataFrame:
    """(a, b, b1, b2): places of b next to one occurrence of a, and between two; pairs with neither are left out."""
    rows = _triples(clusters)
    near = rows.select("g", F.explode(F.array("p", "n")).alias("b")).filter(_real("g") & _real("b") & (F.col("g") != F.col("b")))
    near = near.select(F.col("g").alias("a"), "b", F.lit(1).alias("b1"), F.lit(0).alias("b2"))
    moved = _between(rows).filter(_real("g") & (F.col("g") != F.col("p"))).select(F.col("p").alias("a"), F.col("g").alias("b"), F.lit(-2).alias("b1"), F.lit(1).alias("b2"))
    sums = near.unionByName(moved).groupBy("a", "b").agg(*(F.sum(c).cast("long").alias(c) for c in ("b1", "b2")))
    return sums.filter("b1 != 0 or b2 != 0")


def adjacency_total(clusters: DataFrame) -> DataFrame:
    """(n): all places."""
    return clusters.agg(F.coalesce(F.sum(F.size("genes")), F.lit(0)).cast("long").alias("n"))


def _real_set() -> Column:
    return F.array_distinct(F.filter("genes", lambda g: g != EMPTY))


def colocation_nodes(clusters: DataFrame) -> DataFrame:
    """(gene, cnt, n1): baskets with the gene, and the other places in them (repeats rewritten)."""
    rows = clusters.select((rewritten_length(F.col("genes")) - 1).alias("n1"), F.explode(_real_set()).alias("gene"))
    return rows.groupBy("gene").agg(F.count(F.lit(1)).alias("cnt"), F.sum("n1").cast("long").alias("n1"))


def colocation_pairs(clusters: DataFrame) -> DataFrame:
    """(a, b, b1): baskets with both, in both directions."""
    sets = clusters.select(_real_set().alias("s"))
    rows = sets.select("s", F.explode("s").alias("a")).select("a", F.explode("s").alias("b")).filter("a != b")
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("b1"))


def colocation_total(clusters: DataFrame) -> DataFrame:
    return clusters.agg(F.coalesce(F.sum(rewritten_length(F.col("genes"))), F.lit(0)).cast("long").alias("n"))
