"""The text files of a run: one file for each table, in the formats that other programs read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.functions.genes import genes_text
from basketloom.operators import modules, topics
from basketloom.sources import clusters, tables
from basketloom.sources.onefile import write_file


def cluster_files(baskets: DataFrame, path: str, counts_path: str) -> None:
    """Baskets in the order of ``ord``, or else of their ids, and how often each gene occurs."""
    order = "ord" if "ord" in baskets.columns else "bgc_id"
    write_file(baskets.select(clusters.cluster_line(F.col("bgc_id"), F.col("genes")).alias("value"), order), path, order)
    genes = baskets.select(F.col(order).alias("ord"), F.posexplode("genes").alias("pos", "gene"))
    write_file(clusters.gene_count_lines(genes), counts_path)


def hits_file(hits: DataFrame, path: str) -> None:
    names = [c.split()[0] for c in tables.HITS.split(", ")]
    rows = hits.withColumn("q_range", F.concat_ws(";", F.col("q_start").cast("string"), F.col("q_end").cast("string")))
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names))
    write_file(rows.select(line.alias("value"), "cluster_id", "ord"), path, "cluster_id", "ord", header="\t".join(names))


def representatives_file(members: DataFrame, path: str) -> None:
    write_file(clusters.representative_lines(members), path)


def edges_file(edges: DataFrame, path: str) -> None:
    line = F.concat_ws("\t", "bgc1", "bgc2", F.col("ai").cast("string"), F.when(F.col("contained"), "True").otherwise("False"))
    write_file(edges.select(line.alias("value"), "bgc1", "bgc2"), path, "bgc1", "bgc2")


def modules_file(found: DataFrame, path: str) -> bool:
    """No file for no modules; says whether there were any."""
    if found.isEmpty():
        return False
    names = ["module_id", "n_genes", "n_domains", "strictest_pval", "occurences", "tokenised_genes"]
    rows = tables.module_sizes(found).withColumn("tokenised_genes", genes_text(F.col("genes")))
    write_file(rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in names)).alias("value"), F.col("module_id").alias("k")), path, "k", header="\t".join(names))
    return True


def detected_files(baskets: DataFrame, detected: DataFrame, ids_path: str, path: str) -> None:
    ids = modules.detected_ids(baskets, detected)
    write_file(ids.select(F.concat_ws("\t", "bgc_id", "module_ids").alias("value"), "bgc_id"), ids_path, "bgc_id", header="bgc_id\tmodule_ids")
    write_file(modules.detected_blocks(baskets, detected), path, "bgc_id")


def topic_files(out: str, table: DataFrame, terms: DataFrame, matches: DataFrame, kept: DataFrame, classes: DataFrame, known: DataFrame | None) -> None:
    """Topics, terms, matches by topic and by basket (all, and those that pass the filter), and known groups that they cover."""
    names = table.columns
    write_file(table.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in names)).alias("value"), "topic"), f"{out}/topics.txt", "topic", header="\t".join(names))
    listed = terms.groupBy("gene").agg(F.sort_array(F.collect_list(F.struct("topic", "prob"))).alias("t"))
    text = F.array_join(F.transform("t", lambda t: F.concat(t["topic"].cast("string"), F.lit(":"), F.format_string("%.3f", t["prob"]))), ",")
    write_file(listed.select(F.concat_ws("\t", "gene", text).alias("value"), "gene"), f"{out}/terms_to_topic.txt", "gene")
    for rows, by_topic, by_basket in ((matches, "matches_per_topic", "bgc_topics"), (kept, "matches_per_topic_filtered", "bgc_topics_filtered")):
        write_file(topics.match_lines(rows, classes), f"{out}/{by_topic}.txt", "topic", "place")
        summary = topics.class_summary(rows, classes)
        heads = ["topic", "matches", "matches_len>1", "classes", "classes_len>1"]
        line = F.concat_ws("\t", *(F.col(c).cast("string") for c in ("topic", "matches", "matches_long", "classes", "classes_long")))
        write_file(summary.select(line.alias("value"), "topic"), f"{out}/{by_topic}_summary.txt", "topic", header="\t".join(heads))
        write_file(topics.basket_lines(rows, classes), f"{out}/{by_basket}.txt", "bgc_id")
    if known is not None:
        block = F.concat_ws("\t", F.format_string("%.3f", "overlap"), "bgc_id", F.col("topic").cast("string"), F.format_string("%.3f", "prob"), F.format_string("%.3f", "overlap_score"), "genes", "other_genes")
        lines = known.groupBy("group").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("overlap")).alias("k"), "bgc_id", "topic", block.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
        write_file(lines.select(F.concat(F.lit(">"), "group", F.lit("\n"), "t").alias("value"), "group"), f"{out}/known_subcluster_matches.txt", "group")
