"""Baskets from relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketloom.functions.genes import EMPTY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")


def order_baskets(spark: SparkSession, sf_dir: str, gene: Column | None = None) -> DataFrame:
    """(bgc_id, genes): one basket for each order, its lines in order.

    By default the words of a part's name are the domains of a gene; promotional parts are empty genes.
    """
    gene = F.translate("p_name", " ", ";") if gene is None else gene
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type", "p_size", "p_brand")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER).join(part, "l_partkey")
    rows = rows.withColumn("gene", F.when(F.col("p_type").contains("PROMO"), F.lit(EMPTY)).otherwise(gene))
    items = F.array_sort(F.collect_list(F.struct(*_ORDER, "gene")))
    return rows.groupBy(F.col("l_orderkey").cast("string").alias("bgc_id")).agg(F.transform(items, lambda x: x["gene"]).alias("genes"))


def part_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the part itself as the only domain."""
    return order_baskets(spark, sf_dir, F.concat(F.lit("p"), F.col("l_partkey").cast("string")))


def event_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bgc_id, genes): one basket for each user, events in time; errors are empty genes."""
    gene = F.when(F.col("event_type") == "error", F.lit(EMPTY)).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("bgc_id"), F.struct("ts", "event_id", gene.alias("gene")).alias("e"))
    return rows.groupBy("bgc_id").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["gene"]).alias("genes"))


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain hits from order lines: intervals and scores from their numbers."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.translate("p_name", " ", "_").alias("domain"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", *_ORDER).join(part, "l_partkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER, "domain"))
    start = (F.col("l_partkey") % 100).cast("int")
    return rows.select(
        F.col("l_orderkey").cast("string").alias("cluster_id"), (place - 1).cast("long").alias("ord"), "domain", F.col("l_linenumber").alias("orf_num"),
        start.alias("q_start"), (start + F.col("l_quantity").cast("int")).alias("q_end"), F.col("l_extendedprice").alias("bitscore"),
    )


def nation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bgc_id, class): suppliers and the names of their nations."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("class"))
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").cast("string").alias("bgc_id"), "class")


def word_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bgc_id, genes): one basket for each document, short words of a few first letters in the order in which they first stand."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    kept = F.array_distinct(F.filter(words, lambda w: w.rlike("^[dlu][a-z]{2}$")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("bgc_id"), kept.alias("genes"))


def supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bgc, content): a GenBank file for each supplier."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.translate("p_name", " ", "_").alias("name"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", *(c for c in _ORDER if c != "l_suppkey")).join(part, "l_partkey")
    keys = ("l_orderkey", *(c for c in _ORDER if c != "l_suppkey"))
    place = F.concat_ws("..", F.col("l_partkey").cast("string"), (F.col("l_partkey") + 3 * F.col("l_quantity").cast("long")).cast("string"))
    place = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("complement("), place, F.lit(")"))).otherwise(place)
    qualifier = lambda name, value: F.concat(F.lit(" " * 21 + f'/{name}="'), value, F.lit('"\n'))
    text = F.concat(F.lit("     CDS             "), place, F.lit("\n"), qualifier("gene", F.col("name")), qualifier("protein_id", F.concat(F.lit("P_"), F.col("l_partkey").cast("string"))), qualifier("translation", F.lit("MK")))
    texts = rows.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct(*keys, "name", text.alias("text")))).alias("x"))
    edge = F.when(F.col("l_suppkey") % 7 == 0, F.lit("True")).otherwise(F.lit("False"))
    head = F.concat(F.lit("LOCUS       X 900 bp DNA\nFEATURES             Location/Qualifiers\n     protocluster    1..900\n" + " " * 21 + '/contig_edge="'), edge, F.lit('"\n'))
    whole = F.concat(head, F.array_join(F.transform("x", lambda r: r["text"]), ""), F.lit("ORIGIN\n//\n"))
    name = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.when(F.col("l_suppkey") % 9 == 0, F.lit("_final")).otherwise(F.lit("")))
    return texts.select(name.alias("bgc"), F.when(F.col("l_suppkey") % 11 == 3, F.lit("nothing\n")).otherwise(whole).cast("binary").alias("content"))
