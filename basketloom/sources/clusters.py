"""Cluster files (``id,gene,gene,...``), plain lists and gene counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketloom.functions.genes import EMPTY, genes_text, n_nonempty
from basketloom.operators.filters import sized
from basketloom.operators.lineage import cut


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) with white space at the ends removed; ``ord`` follows the files by path, then their lines.

    Spark packs pieces of files into partitions by size, so the pieces are numbered by path and offset.  There is a
    narrow row for each piece; ``ord`` has its number above bit 33 and counts lines below.
    """
    piece = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    rows = spark.read.text(path).select(*piece, F.monotonically_increasing_id().alias("_id"), "value")
    pieces = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_first"))
    pieces = pieces.withColumn("_piece", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_file", "_start")) - 1)
    ord_ = F.shiftleft(F.col("_piece").cast("long"), 33) + F.col("_id") - F.col("_first")
    return rows.join(sized(cut(pieces)), ["_file", "_start"]).select(ord_.alias("ord"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))


def parse_line(line: Column) -> tuple[Column, Column]:
    """(id, list of gene strings) of a cluster line."""
    parts = F.split(line, ",")
    return parts[0], F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def read_clusters(spark: SparkSession, path: str, duplicates: str = "last", min_genes: int = 0) -> DataFrame:
    """(ord, bgc_id, genes) of a cluster file, one row for each id.

    Of repeated ids the ``last`` or the ``first`` line counts; its place is always that of the first line.
    Baskets with fewer than ``min_genes`` non-empty genes are left out.
    """
    bgc_id, genes = parse_line(F.col("line"))
    rows = read_lines(spark, path).filter("line != ''").select("ord", bgc_id.alias("bgc_id"), genes.alias("genes"))
    rows = one_per_id(rows, duplicates)
    return rows.filter(n_nonempty(F.col("genes")) >= min_genes) if min_genes > 0 else rows


def one_per_id(rows: DataFrame, duplicates: str = "last") -> DataFrame:
    """Of the rows (ord, bgc_id, genes) of one id the last or first one counts; its place is that of the first."""
    pick = F.max_by if duplicates == "last" else F.min_by
    return rows.groupBy("bgc_id").agg(F.min("ord").alias("ord"), pick("genes", "ord").alias("genes")).select("ord", "bgc_id", "genes")


def cluster_line(bgc_id: Column, genes: Column) -> Column:
    return F.concat_ws(",", bgc_id, genes_text(genes))


def write_lines(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a single string column as text."""
    lines.write.mode(mode).text(path)


def write_clusters(clusters: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One line for each basket, in the order of ``ord`` where there is one."""
    ordered = clusters.orderBy("ord") if "ord" in clusters.columns else clusters
    write_lines(ordered.select(cluster_line(F.col("bgc_id"), F.col("genes")).alias("value")), path, mode)


def exploded(clusters: DataFrame) -> DataFrame:
    """(bgc_id, pos, gene) with positions from 0."""
    keep = [c for c in ("ord",) if c in clusters.columns]
    return clusters.select("bgc_id", *keep, F.posexplode("genes").alias("pos", "gene"))


def collected(genes: DataFrame) -> DataFrame:
    """(bgc_id, genes) from (bgc_id, pos, gene)."""
    return genes.groupBy("bgc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "gene"))), lambda x: x["gene"]).alias("genes"))


def gene_counts(genes: DataFrame) -> DataFrame:
    """(gene, n) of all gene occurrences, empty ones included."""
    return genes.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


def gene_count_lines(genes: DataFrame) -> DataFrame:
    """Text of a gene count file: the total, then genes by count, ties as first seen in (ord, pos)."""
    counts = genes.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("first"))
    total = counts.agg(F.concat(F.lit("#Total\t"), F.coalesce(F.sum("n"), F.lit(0)).cast("string")).alias("value"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("n"))
    body = counts.select(F.concat_ws("\t", "gene", F.col("n").cast("string")).alias("value"), F.lit(1).alias("part"), "n", "first")
    return total.unionByName(body, allowMissingColumns=True).orderBy("part", F.col("n").desc(), "first").select("value")


def read_representatives(spark: SparkSession, path: str) -> DataFrame:
    """(rep, member) rows of a representatives file."""
    parts = F.split("line", "\t")
    return read_lines(spark, path).filter("line != ''").select(parts[0].alias("rep"), F.explode(F.split(parts[1], ",")).alias("member"))


def representative_lines(members: DataFrame) -> DataFrame:
    """``rep<TAB>m1,m2`` with the members in order."""
    lists = members.groupBy("rep").agg(F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members"))
    return lists.orderBy("rep").select(F.concat_ws("\t", "rep", "members").alias("value"))


def carried_header(lines: DataFrame, is_header: Column, block: Column | None = None) -> DataFrame:
    """Adds ``header``: the nearest header line at or above each line.

    Lines of one file keep their order in ``ord``.  The last header of each earlier partition of lines is carried
    over in two steps, so no task sees the whole file: headers per block of lines, then within the block.  ``block``
    numbers the blocks, in the order of ``ord``.
    """
    block = F.shiftright("ord", 33) if block is None else block  # the partition part of monotonically_increasing_id
    rows = lines.withColumn("_block", block).withColumn("_own", F.when(is_header, F.col("line")))
    last = rows.filter("_own is not null").groupBy("_block").agg(F.max_by("_own", "ord").alias("_last"))
    blocks = rows.select("_block").distinct().join(last, "_block", "left")
    before = Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.last("_last", ignorenulls=True).over(before)).select("_block", "_before")
    within = Window.partitionBy("_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_here", F.last("_own", ignorenulls=True).over(within)).join(blocks, "_block")
    return rows.withColumn("header", F.coalesce("_here", "_before")).drop("_block", "_own", "_here", "_before")


def with_empty(genes: Column) -> Column:
    """A list of gene strings with blanks read as empty genes."""
    return F.transform(genes, lambda g: F.when(g == "", F.lit(EMPTY)).otherwise(g))
