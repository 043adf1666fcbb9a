"""Queries that write the test tables in each file format and read them back."""

from __future__ import annotations

import threading
from functools import wraps

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.functions.genes import genes_text
from basketloom.operators import filters, lineage, modules, render, topic_training, topics
from basketloom.operators.lineage import numbered
from basketloom.sources import clusters, tables

from .adapters import line_hits, order_baskets, table
from .queries import _known_modules, rounded
from .queries import query as registered


class _Files(threading.local):
    """Files that the running query of this thread wrote."""

    def __init__(self):
        self.paths: list[str] = []


_files = _Files()


def new_path(spark: SparkSession, name: str) -> str:
    _files.paths.append(lineage.new_path(spark, name))
    return _files.paths[-1]


def query(f):
    """Registers a query that writes files; its result is read from a checkpoint and the files are deleted.

    Where the session names no folder for checkpoints the result still reads the files, which stay.
    """

    @registered
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _files.paths = []
        out = f(spark, sf_dir)
        if _files.paths and spark.conf.get("spark.checkpoint.dir", None):
            out = lineage.cut(out)
            for path in _files.paths:
                lineage.remove(spark, path)
        return out

    return run


def text_file(lines: DataFrame, *order: str) -> str:
    """Path of a file (in parts) with the column ``line``, in the given order."""
    path = new_path(lines.sparkSession, "lines")
    clusters.write_lines(lines.orderBy(*order).select(F.col("line").alias("value")), path)
    return path


def tabbed(*columns: Column | str) -> Column:
    return F.concat_ws("\t", *columns).alias("line")


@query
def lines_file(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line"))
    return numbered(clusters.read_lines(spark, text_file(lines, "event_id")), "line_no", "ord").select("line_no", "line")


def _clusters_file(spark: SparkSession, sf_dir: str, duplicates: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("bgc_id"), F.array("event_type", F.col("event_id").cast("string")).alias("genes"))
    path = new_path(spark, "clusters")
    clusters.write_clusters(rows, path)
    return clusters.read_clusters(spark, path, duplicates).select("bgc_id", genes_text(F.col("genes")).alias("genes"))


@query
def clusters_file_last(spark, sf_dir):
    return _clusters_file(spark, sf_dir, "last")


@query
def clusters_file_first(spark, sf_dir):
    return _clusters_file(spark, sf_dir, "first")


@query
def modules_file(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("module_id"), F.array(F.translate("p_name", " ", ";"), F.col("p_brand")).alias("genes"), (F.col("p_size") / 64).alias("strictest_pval"), F.col("p_size").cast("long").alias("occurences")
    )
    path = new_path(spark, "modules")
    tables.write_modules(rows, path)
    return tables.read_modules(spark, path).withColumn("genes", genes_text(F.col("genes")))


@query
def module_sizes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    lists = part.groupBy("p_brand").agg(F.array_sort(F.collect_set(F.translate("p_name", " ", ";"))).alias("genes"))
    return tables.module_sizes(lists).select("p_brand", "n_genes", "n_domains")


@query
def edges_file(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    rows = supplier.select(F.col("s_suppkey").cast("string").alias("bgc1"), F.col("s_nationkey").cast("string").alias("bgc2"), (F.col("s_nationkey") / 32).alias("ai"), (F.col("s_suppkey") % 2 == 0).alias("contained"))
    path = new_path(spark, "edges")
    tables.write_edges(rows, path)
    return tables.read_edges(spark, path)


@query
def dictionary_file(spark, sf_dir):
    """The last customer of each nation counts; the first line is a header."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("|", "c_nationkey", "c_mktsegment", "c_custkey").alias("line"))
    head = spark.createDataFrame([(-1, "0|nation|segment")], "c_custkey long, line string")
    found = tables.read_dictionary(spark, text_file(rows.unionByName(head), "c_custkey"), "|", header=True)
    return found.select("key", F.array_join("values", ";").alias("values"))


@query
def known_groups_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", tabbed("p_partkey", "p_brand", "p_type", F.translate("p_name", " ", ",")))
    found = tables.read_known_groups(spark, text_file(rows, "p_partkey"))
    return found.select("bgc", F.array_join("info", ";").alias("info"), genes_text(F.col("genes")).alias("genes"))


@query
def products_file(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    rows = table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(
        F.col("s_suppkey").alias("ID"), F.col("s_name").alias("NAME"), F.col("s_nationkey").alias("MASS"), F.col("n_regionkey").alias("FORMULA"), F.col("n_name").alias("GENUS"), F.concat(F.lit("sp "), "s_name").alias("SPECIES"),
        F.when(F.col("s_suppkey") % 2 == 0, "TRUE").otherwise("FALSE").alias("COMPOUND_HAS_MIBIG"),
    )
    path = new_path(spark, "products")
    rows.write.csv(path, sep="\t", header=True, quote="")
    return tables.read_products(spark, path).withColumn("info", F.array_join("info", ";"))


@query
def taxonomy_file(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", tabbed((F.col("c_custkey") % 100).cast("string"), F.concat_ws(" ", "c_mktsegment", "c_name")))
    return tables.read_taxonomy(spark, text_file(rows, "c_custkey"))


@query
def hits_file(spark, sf_dir):
    rows = line_hits(spark, sf_dir).select(
        F.concat_ws("_", "cluster_id", F.col("ord").cast("string")).alias("bgc"), F.lit("g").alias("g_id"), F.lit("P").alias("p_id"), F.lit("0;9;+").alias("location"), F.col("orf_num").cast("int").alias("orf_num"),
        F.lit(7).alias("tot_orf"), "domain", "q_start", "q_end", "bitscore",
    )
    path = new_path(spark, "hits")
    tables.write_hits(rows, path)
    return tables.read_hits(spark, path).select("bgc", "location", "orf_num", "tot_orf", "domain", "q_start", "q_end", "bitscore")


@query
def colours_file(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = nation.select("n_nationkey", tabbed("n_name", F.concat_ws(",", "n_nationkey", F.lit(" 7"), (F.col("n_regionkey") * 50).cast("string"))))
    return tables.read_colours(spark, text_file(rows.unionByName(spark.createDataFrame([(-1, "# name\trgb")], "n_nationkey long, line string")), "n_nationkey"))


@query
def categories_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", tabbed("p_brand", F.concat(F.lit("d"), F.col("p_partkey").cast("string"))))
    return tables.read_categories(spark, text_file(rows, "p_partkey"))


@query
def representatives_file(spark, sf_dir):
    members = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("string").alias("rep"), F.col("s_suppkey").cast("string").alias("member"))
    path = new_path(spark, "representatives")
    clusters.write_lines(clusters.representative_lines(members), path)
    return clusters.read_representatives(spark, path)


@query
def topic_matches_file(spark, sf_dir):
    """Matches of topics (nations) in blocks under header lines; two topics are asked for."""
    supplier = table(spark, sf_dir, "supplier")
    head = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(-1).cast("long").alias("s_suppkey"), F.concat(F.lit("#Topic "), F.col("n_nationkey").cast("string"), F.lit(", with matches")).alias("line"))
    genes = F.concat(F.lit("g"), F.col("s_suppkey").cast("string"), F.lit(":0.5,h:1"))
    rows = supplier.select("s_nationkey", "s_suppkey", tabbed((F.col("s_nationkey") / 32).cast("string"), F.lit("0.25"), genes, F.col("s_suppkey").cast("string"), F.lit("kind")))
    found = tables.read_topic_matches(spark, text_file(rows.unionByName(head), "s_nationkey", "s_suppkey"), ["3", "5"])
    return found.select("bgc", "topic", "prob", "overlap", genes_text(F.col("genes")).alias("genes"), "class")


@query
def module_blocks_file(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    head = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lit(-1).cast("long").alias("s_suppkey"), F.concat(F.lit(">"), F.col("n_name")).alias("line"))
    rows = supplier.select("s_nationkey", "s_suppkey", tabbed(F.col("s_suppkey").cast("string"), F.lit("i"), F.concat(F.lit("a:1,g"), F.col("s_suppkey").cast("string"), F.lit(":2"))))
    found = tables.read_module_blocks(spark, text_file(rows.unionByName(head), "s_nationkey", "s_suppkey"), "topic")
    return found.select("bgc", F.array_join("info", ";").alias("info"), genes_text(F.col("genes")).alias("genes"))


@query
def detected_blocks(spark, sf_dir):
    baskets = order_baskets(spark, sf_dir)
    return modules.detected_blocks(baskets, modules.detect(baskets, _known_modules(spark, sf_dir)))


@query
def selected_modules(spark, sf_dir):
    """Rows of chosen names; what is chosen is the operator's own parameter."""
    return filters.selected(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), p_brand=["Brand#2", "Brand#17"])


@query
def drawn_modules(spark, sf_dir):
    """Which modules of a file are drawn for each basket, and in what order: of some families, by clan and family."""
    part = table(spark, sf_dir, "part").select(F.translate("p_brand", "#", "_").alias("brand"), "p_partkey", "p_size", "p_name")
    row = tabbed(F.col("p_partkey").cast("string"), F.lit("2\t2\t0.1\t3"), F.translate("p_name", " ", ","), F.col("p_size").cast("string"), (F.col("p_partkey") % 3).cast("string"))
    head = part.select("brand").distinct().select("brand", F.lit(-1).cast("long").alias("p_partkey"), F.concat(F.lit(">"), "brand").alias("line"))
    blocks = tables.read_module_blocks(spark, text_file(part.select("brand", "p_partkey", row).unionByName(head), "brand", "p_partkey"), "stat")
    chosen = render.chosen_modules(blocks, "stat", families=[str(k) for k in range(5, 30)])
    return chosen.select("bgc", "place", "module", genes_text(F.col("genes")).alias("genes"))


def _table_model(spark: SparkSession, sf_dir: str) -> topics.TopicModel:
    """A topic for each brand, its terms the names of its parts, saved and loaded again."""
    brand = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    counts = table(spark, sf_dir, "part").groupBy(brand.alias("brand"), F.translate("p_name", " ", ";").alias("gene")).count().collect()  # brands times names
    brands, genes = sorted({r["brand"] for r in counts}), sorted({r["gene"] for r in counts})
    weight = np.zeros((len(brands), len(genes)))
    for r in counts:
        weight[brands.index(r["brand"]), genes.index(r["gene"])] = r["count"]
    path = new_path(spark, "model")
    alpha, eta = topic_training.priors(len(brands), None, None)
    topics.TopicModel(topic_training.State(genes, weight, alpha, eta, 1, 1)).save(path)
    return topics.TopicModel.load(path)


@query
def term_topics(spark, sf_dir):
    """Terms with their chances in the topics of a loaded model."""
    return rounded(_table_model(spark, sf_dir).term_topics(spark), "prob")


@query
def top_terms(spark, sf_dir):
    """The ten best terms of each topic of a loaded model."""
    return _table_model(spark, sf_dir).terms(spark, 10).select("topic", "rank", "gene")


@query
def topic_vocabulary(spark, sf_dir):
    """Genes that a model of the orders would know: neither rare nor in more than a share of the baskets, most frequent first."""
    words = topic_training.vocabulary_of(order_baskets(spark, sf_dir), 5, 0.07, 100_000)
    return spark.createDataFrame(list(enumerate(words)), "place int, gene string")
