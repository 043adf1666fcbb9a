"""Filters over baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.functions.genes import DOMAIN_SEP, EMPTY, base_name, gene_domains, gene_string, n_nonempty

#: A list of names of at most this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def with_min_genes(clusters: DataFrame, least: int) -> DataFrame:
    """Baskets with at least ``least`` non-empty genes."""
    return clusters.filter(n_nonempty(F.col("genes")) >= least)


def keep_domains(genes: DataFrame, include: DataFrame) -> DataFrame:
    """(bgc_id, pos, gene) with only the domains whose base name is in ``include`` (domain); positions stay."""
    keys = [c for c in genes.columns if c != "gene"]
    names = include.select(F.col("domain").alias("_base")).distinct()
    # Each distinct gene is looked at once; there are far fewer of them than occurrences.
    kinds = genes.select("gene").distinct().select("gene", F.posexplode(gene_domains(F.col("gene"))).alias("k", "d"))
    kept = kinds.withColumn("_base", base_name(F.col("d"))).join(sized(names), "_base", "left_semi")
    kept = kept.groupBy("gene").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]).alias("ds"))
    out = genes.join(kept, "gene", "left")
    return out.select(*keys, F.coalesce(gene_string(F.col("ds")), F.lit(EMPTY)).alias("gene"))


def filter_domains(genes: DataFrame, include: DataFrame, least: int = 2) -> DataFrame:
    """``keep_domains``, then only baskets with at least ``least`` non-empty genes."""
    return having_genes(keep_domains(genes, include), least)


def having_genes(genes: DataFrame, least: int, distinct: bool = False) -> DataFrame:
    """Rows of the baskets with at least ``least`` (``distinct``) non-empty genes."""
    real = F.when(F.col("gene") != EMPTY, F.col("gene"))
    enough = genes.groupBy("bgc_id").agg((F.count_distinct(real) if distinct else F.count(real)).alias("n")).filter(F.col("n") >= least)
    return genes.join(enough.select("bgc_id"), "bgc_id", "left_semi")


def mask_infrequent(genes: DataFrame, least: int, cutoff: int, distinct: bool = False) -> DataFrame:
    """Genes with fewer than ``cutoff`` occurrences become empty; baskets left with fewer than ``least`` genes go.

    Counts are summed before they are joined back, so a frequent gene is no hot key of the count.
    """
    frequent = genes.filter(F.col("gene") != EMPTY).groupBy("gene").count().filter(F.col("count") >= cutoff).select("gene", F.lit(True).alias("_kept"))
    masked = genes.join(frequent, "gene", "left").withColumn("gene", F.when(F.col("_kept"), F.col("gene")).otherwise(F.lit(EMPTY))).drop("_kept")
    return having_genes(masked.select(genes.columns), least, distinct)


def domains_per_basket(genes: DataFrame) -> DataFrame:
    """(bgc_id, n_domains): domains of all non-empty genes; 0 for baskets without any."""
    size = F.when(F.col("gene") != EMPTY, F.size(gene_domains(F.col("gene")))).otherwise(0)
    return genes.groupBy("bgc_id").agg(F.sum(size).cast("long").alias("n_domains"))


def without_names(files: DataFrame, words: list[str], name: str = "name") -> DataFrame:
    """Rows whose name holds none of the words."""
    held = [F.col(name).contains(w) for w in words]
    out = F.lit(False)
    for h in held:
        out = out | h
    return files.filter(~out)


def selected(df: DataFrame, **values: list) -> DataFrame:
    """Rows whose columns have one of the given values; a column with None is not looked at."""
    for column, wanted in values.items():
        if wanted is not None:
            df = df.filter(F.col(column).isin(list(wanted)))
    return df


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def flat(genes: DataFrame) -> DataFrame:
    """(bgc_id, k, domain): all domains of a basket in order, numbered from 0 by (position, place in the gene)."""
    rows = genes.select("bgc_id", "pos", F.posexplode(F.split("gene", DOMAIN_SEP)).alias("j", "domain"))
    return rows
