"""One query for each operator, over the relational test tables.

Text stands in for lists in the results, so that other engines can be held against them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketloom.functions.genes import adjacent_pairs, base_name, genes_text, n_nonempty
from basketloom.operators import filters, interactions, lineage, link, modules, overlap, pvalues, render, similarity, topics
from basketloom.sources import clusters, domtable, genbank
from basketloom.streaming.detect import gene_counts_by_window

from . import adapters
from .adapters import order_baskets, part_baskets, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query
def gene_counts(spark, sf_dir):
    return clusters.gene_counts(clusters.exploded(order_baskets(spark, sf_dir)))


@query
def gene_count_lines(spark, sf_dir):
    baskets = order_baskets(spark, sf_dir).withColumn("ord", F.col("bgc_id").cast("long"))
    return clusters.gene_count_lines(clusters.exploded(baskets))


@query
def nonempty_gene_counts(spark, sf_dir):
    return order_baskets(spark, sf_dir).select("bgc_id", n_nonempty(F.col("genes")).alias("n_genes"))


@query
def min_genes_filter(spark, sf_dir):
    return filters.with_min_genes(order_baskets(spark, sf_dir), 3).select("bgc_id", genes_text(F.col("genes")).alias("genes"))


@query
def suffix_strip(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = F.concat(F.split("p_name", " ")[0], F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_c"), F.col("p_size").cast("string"))).otherwise(F.lit("_c")))
    return part.groupBy(base_name(name).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def _include(spark, sf_dir):
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("domain")).distinct()
    return words.filter("domain < 'n'")


@query
def include_list_filter(spark, sf_dir):
    return filters.filter_domains(clusters.exploded(order_baskets(spark, sf_dir)), _include(spark, sf_dir), 2)


def _rare(spark, sf_dir):
    return clusters.exploded(order_baskets(spark, sf_dir, F.concat(F.translate("p_name", " ", ";"), F.lit("_c"), F.col("p_size").cast("string"))))


@query
def infrequent_mask(spark, sf_dir):
    return filters.mask_infrequent(_rare(spark, sf_dir), 2, 20)


@query
def infrequent_mask_distinct(spark, sf_dir):
    return filters.mask_infrequent(clusters.exploded(order_baskets(spark, sf_dir)), 3, 3, distinct=True)


def _event_lines(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("bgc_id"), F.array("event_type", F.col("user_id").cast("string")).alias("genes"))


@query
def duplicate_first(spark, sf_dir):
    return clusters.one_per_id(_event_lines(spark, sf_dir), "first").select("ord", "bgc_id", genes_text(F.col("genes")).alias("genes"))


@query
def duplicate_last(spark, sf_dir):
    return clusters.one_per_id(_event_lines(spark, sf_dir), "last").select("ord", "bgc_id", genes_text(F.col("genes")).alias("genes"))


@query
def cluster_line_roundtrip(spark, sf_dir):
    lines = order_baskets(spark, sf_dir).select(clusters.cluster_line(F.col("bgc_id"), F.col("genes")).alias("line"))
    bgc_id, genes = clusters.parse_line(F.col("line"))
    return lines.select("line", bgc_id.alias("bgc_id"), genes_text(genes).alias("genes"), F.size(genes).alias("n"))


@query
def excluded_names(spark, sf_dir):
    return filters.without_names(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), ["ring", "red"])


@query
def interval_overlap_survivors(spark, sf_dir):
    kept = overlap.survivors(adapters.line_hits(spark, sf_dir), ["cluster_id"], "ord", 0.1)
    return kept.select("cluster_id", "ord", "q_start", "q_end", "bitscore")


@query
def domain_hits(spark, sf_dir):
    """From text lines of a profile search to surviving hits."""
    h = adapters.line_hits(spark, sf_dir)
    head = F.concat("cluster_id", F.lit("_gid:_pid:P_loc:0;9;+_"), F.col("orf_num").cast("string"), F.lit("/7"))
    line = F.concat_ws(" ", "domain", F.lit("- 1"), head, F.lit("- 1 0 0 0 1 1 0 0"), F.format_string("%.2f", "bitscore"), F.lit("0 1 1"), (F.col("q_start") + 1).cast("string"), F.col("q_end").cast("string"), F.lit("1 1 0.9 -"))
    rows = domtable.parse_rows(h.select("cluster_id", "ord", line.alias("line")))
    return domtable.hits(rows, 0.1).select("cluster_id", "ord", "bgc", "g_id", "p_id", "location", "orf_num", "tot_orf", "domain", "q_start", "q_end", "bitscore")


@query
def unreadable_tables(spark, sf_dir):
    """One line that cannot be read, or that is cut off, drops its whole table; no other."""
    h = adapters.line_hits(spark, sf_dir)
    head = F.concat("cluster_id", F.lit("_gid:_pid:P_loc:0;9;+_"), F.col("orf_num").cast("string"), F.lit("/7"))
    bad = (F.col("cluster_id").cast("long") % 50 == 7) & (F.col("ord") == 0)
    score = F.when(bad, F.lit("-")).otherwise(F.format_string("%.2f", "bitscore"))
    line = F.concat_ws(" ", "domain", F.lit("- 1"), head, F.lit("- 1 0 0 0 1 1 0 0"), score, F.lit("0 1 1"), (F.col("q_start") + 1).cast("string"), F.col("q_end").cast("string"), F.lit("1 1 0.9 -"))
    remark = F.when(F.col("cluster_id").cast("long") % 50 == 8, F.lit("cut off")).otherwise(F.lit("# a remark"))
    one = F.struct("ord", line.alias("line"))
    lines = F.when(F.col("ord") == 0, F.array(F.struct(F.lit(-1).cast("long").alias("ord"), remark.alias("line")), one)).otherwise(F.array(one))
    rows = domtable.parse_rows(h.select("cluster_id", F.inline(lines)))
    return domtable.hits(rows, 0.1).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("hits"))


@query
def genbank_records(spark, sf_dir):
    """Suppliers as GenBank files with a coding sequence for each delivery; some are excluded, cut off by a contig's edge, or no such files."""
    return genbank.parse_files(adapters.supplier_files(spark, sf_dir)).fillna({"n": 0, "header": "", "sequence": ""})


@query
def gap_fill(spark, sf_dir):
    return domtable.clusters(adapters.line_hits(spark, sf_dir).withColumn("tot_orf", F.lit(7)))


@query
def domain_lengths(spark, sf_dir):
    return filters.domains_per_basket(clusters.exploded(order_baskets(spark, sf_dir)))


@query
def adjacent_domain_pairs(spark, sf_dir):
    return order_baskets(spark, sf_dir).select("bgc_id", F.explode(adjacent_pairs(F.col("genes"))).alias("pair"))


def _real_parts(spark, sf_dir):
    return filters.with_min_genes(part_baskets(spark, sf_dir), 1)


@query
def adjacency_index_pairs(spark, sf_dir):
    return rounded(similarity.links(_real_parts(spark, sf_dir), 0.0, contained=False).pairs().select("bgc1", "bgc2", "ai"), "ai")


@query
def containment_pairs(spark, sf_dir):
    return similarity.links(_real_parts(spark, sf_dir), None).pairs().select("bgc1", "bgc2")


@query
def similarity_edges(spark, sf_dir):
    return rounded(similarity.similarity_edges(_real_parts(spark, sf_dir), 0.3), "ai")


@query
def unique_baskets(spark, sf_dir):
    return similarity.links(_real_parts(spark, sf_dir), 0.3).unlinked()


def _sparse_links(spark, sf_dir):
    return similarity.links(filters.with_min_genes(part_baskets(spark, sf_dir), 3), 0.2)


@query
def connected_components(spark, sf_dir):
    return _sparse_links(spark, sf_dir).components()


@query
def representatives(spark, sf_dir):
    baskets = lineage.cut(filters.with_min_genes(part_baskets(spark, sf_dir), 3))
    found = similarity.representatives(baskets, similarity.links(baskets, 0.2))
    lineage.drop(baskets)
    return found


@query
def adjacency_node_counts(spark, sf_dir):
    return interactions.adjacency_nodes(order_baskets(spark, sf_dir))


@query
def adjacency_pair_counts(spark, sf_dir):
    return interactions.adjacency_pairs(order_baskets(spark, sf_dir))


@query
def colocation_node_counts(spark, sf_dir):
    return interactions.colocation_nodes(order_baskets(spark, sf_dir))


@query
def colocation_pair_counts(spark, sf_dir):
    return interactions.colocation_pairs(order_baskets(spark, sf_dir))


@query
def position_totals(spark, sf_dir):
    baskets = order_baskets(spark, sf_dir)
    one = interactions.adjacency_total(baskets).select(F.lit("adjacency").alias("kind"), "n")
    return one.unionByName(interactions.colocation_total(baskets).select(F.lit("colocation").alias("kind"), "n"))


@query
def colocation_pvalues(spark, sf_dir):
    return rounded(pvalues.colocation_pvalues(order_baskets(spark, sf_dir)), "pval")


@query
def adjacency_pvalues(spark, sf_dir):
    return rounded(pvalues.adjacency_pvalues(order_baskets(spark, sf_dir)), "pval")


@query
def adjusted_pvalues(spark, sf_dir):
    return rounded(pvalues.adjusted(pvalues.colocation_pvalues(order_baskets(spark, sf_dir))).select("a", "b", "adj"), "adj")


@query
def interaction_edges(spark, sf_dir):
    return rounded(pvalues.interaction_edges(order_baskets(spark, sf_dir)), "pval")


def _weak_edges(spark, sf_dir):
    """Edges by the larger uncorrected p-value of the two directions, up to 0.1."""
    raw = pvalues.colocation_pvalues(order_baskets(spark, sf_dir))
    return modules.significant(pvalues.both_directions(raw.withColumnRenamed("pval", "adj")), 0.1)


@query
def significant_edges(spark, sf_dir):
    return rounded(_weak_edges(spark, sf_dir), "pval")


def _text(df, *columns):
    return df.withColumns({c: genes_text(F.col(c)) for c in columns})


@query
def modules_maximal(spark, sf_dir):
    return rounded(_text(modules.find_modules(_weak_edges(spark, sf_dir)), "genes"), "strictest_pval")


def _modules(spark, sf_dir):
    return modules.find_modules(_weak_edges(spark, sf_dir))


@query
def triangle_modules(spark, sf_dir):
    return rounded(_text(_modules(spark, sf_dir).filter(F.size("genes") == 3), "genes"), "strictest_pval")


@query
def module_occurrences(spark, sf_dir):
    return _text(modules.occurrences(order_baskets(spark, sf_dir), _modules(spark, sf_dir)), "genes").select("genes", "occurences")


@query
def filtered_modules(spark, sf_dir):
    found = modules.occurrences(order_baskets(spark, sf_dir), _modules(spark, sf_dir))
    return rounded(_text(modules.filter_infrequent(found, 2), "genes"), "strictest_pval").select("module_id", "genes", "strictest_pval", "occurences")


def _known_modules(spark, sf_dir):
    return modules.with_ids(_modules(spark, sf_dir))


@query
def detected_modules(spark, sf_dir):
    return _text(modules.detect(order_baskets(spark, sf_dir), _known_modules(spark, sf_dir)), "genes").select("bgc_id", "genes")


@query
def detected_module_ids(spark, sf_dir):
    baskets = order_baskets(spark, sf_dir)
    return modules.detected_ids(baskets, modules.detect(baskets, _known_modules(spark, sf_dir)))


@query
def built_modules(spark, sf_dir):
    """The whole statistical branch over masked baskets: words that go together in documents."""
    masked = clusters.collected(filters.mask_infrequent(clusters.exploded(adapters.word_baskets(spark, sf_dir)), 2, 3))
    return rounded(_text(modules.build_modules(masked, 0.01), "genes"), "strictest_pval")


def _terms(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    topic = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    counts = part.groupBy(topic.alias("topic"), F.translate("p_name", " ", ";").alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    share = counts.groupBy("topic").agg(F.sum("n").alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "gene", "n"))).alias("x"))
    rows = share.select("topic", "all", F.posexplode("x").alias("rank", "x"))
    return rows.select("topic", "rank", F.col("x.gene").alias("gene"), F.round(F.col("x.n") / F.col("all") - 0.01, 3).alias("score"))


@query
def feature_selection(spark, sf_dir):
    return topics.topic_features(_terms(spark, sf_dir), 0.5, 10)


@query
def topic_table(spark, sf_dir):
    """Names of the selected features only: other engines print numbers otherwise."""
    return topics.topic_table(topics.topic_features(_terms(spark, sf_dir), 0.5, 10)).select("topic", "number_ldavis", "topic_length", "genes")


def _links(spark, sf_dir):
    """Genes of suppliers in topics: part names and brands of what they deliver."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.translate("p_name", " ", ";").alias("gene"), F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("topic"))
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").join(part, "l_partkey").groupBy(F.col("l_suppkey").cast("string").alias("bgc_id"), "topic", "gene").agg((F.count(F.lit(1)) * 0.25).alias("p"))
    return rows.withColumn("prob", F.round(1 / (F.col("topic") + 1), 6)).select("bgc_id", "topic", "prob", "gene", "p")


def _features(spark, sf_dir):
    return topics.topic_features(_terms(spark, sf_dir), 0.5, 10)


def _matches(spark, sf_dir):
    return topics.scored_matches(_links(spark, sf_dir), _features(spark, sf_dir))


@query
def overlap_scores(spark, sf_dir):
    rows = _matches(spark, sf_dir)
    return rounded(rows.select("bgc_id", "topic", "prob", F.size("feats").alias("n_feats"), "overlap_score"), "overlap_score")


def _filtered(spark, sf_dir):
    return topics.filter_matches(_matches(spark, sf_dir), _features(spark, sf_dir), 0.3, 1.1, 0.05)


@query
def match_filter(spark, sf_dir):
    rows = _filtered(spark, sf_dir)
    genes = F.array_join(F.array_sort(F.transform("feats", lambda f: f["gene"])), ",")
    return rounded(rows.select("bgc_id", "topic", genes.alias("genes"), "overlap_score"), "overlap_score")


@query
def class_summary(spark, sf_dir):
    return topics.class_summary(_filtered(spark, sf_dir), adapters.nation_classes(spark, sf_dir))


@query
def topic_class_counts(spark, sf_dir):
    return topics.topic_class_counts(_filtered(spark, sf_dir), adapters.nation_classes(spark, sf_dir))


@query
def topics_per_basket(spark, sf_dir):
    baskets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("bgc_id"))
    return topics.topics_per_basket(_filtered(spark, sf_dir), baskets, long_only=True)


@query
def match_lengths(spark, sf_dir):
    lengths = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("bgc_id")).agg((F.count(F.lit(1)) % 7).cast("int").alias("len_bgc"))
    return topics.match_lengths(_filtered(spark, sf_dir), lengths)


def _known(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("k"), F.floor(F.col("p_partkey") / 4).cast("string")).alias("group"), F.translate("p_name", " ", ";").alias("g"), "p_partkey")
    return part.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "g"))), lambda x: x["g"]).alias("genes"))


@query
def known_overlap(spark, sf_dir):
    rows = topics.known_overlap(_filtered(spark, sf_dir), _known(spark, sf_dir), 0.4)
    return rows.select("group", "overlap", "n_overlap", "bgc_id", "topic")


@query
def known_by_threshold(spark, sf_dir):
    return topics.known_by_threshold(topics.best_overlaps(_filtered(spark, sf_dir), _known(spark, sf_dir), 0.4), _known(spark, sf_dir))


@query
def lda_topics(spark, sf_dir):
    """Topics of a model of orders' parts; random by nature, so only its shape is fixed."""
    baskets = filters.with_min_genes(order_baskets(spark, sf_dir, F.col("p_brand")), 2)
    model = topics.TopicModel.train(baskets, topics=4, iterations=10, seed=7)
    return model.terms(spark, 10)


@query
def product_link(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    species = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("BUILDING", "machinery", "Household"))), (F.col("s_suppkey") % 3 + 1).cast("int")), F.when(F.col("s_suppkey") % 2 == 0, F.lit("t1")))
    products = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").cast("string").alias("np_id"), F.lower(F.concat("n_name", F.lit(" "))).alias("genus"), species.alias("species"))
    customers = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    taxonomy = customers.select(F.col("c_custkey").cast("string").alias("bgc"), F.concat_ws(" ", "n_name", "c_mktsegment", F.when(F.col("c_custkey") % 4 == 0, F.lit("T1"))).alias("taxonomy"))
    return link.link_products(products, taxonomy).select("np_id", "bgc", "level")


@query
def hit_geometry(spark, sf_dir):
    h = adapters.line_hits(spark, sf_dir)
    strand = F.when(F.col("ord") % 2 == 0, F.lit("+")).otherwise(F.lit("-"))
    rows = h.select(F.col("cluster_id").alias("bgc"), F.col("orf_num"), F.concat(F.lit("<10;1000;"), strand).alias("location"), "domain", "q_start", "q_end")
    return render.hit_geometry(rows)


@query
def drawn_baskets(spark, sf_dir):
    h = adapters.line_hits(spark, sf_dir)
    rows = h.select(F.col("cluster_id").alias("bgc"), "orf_num", F.concat_ws(";", (F.col("orf_num") * 1000).cast("string"), (F.col("orf_num") * 1000 + 900).cast("string"), F.lit("+")).alias("location"), "domain", "q_start", "q_end")
    return render.render(rows)


@query
def header_carry_forward(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line"))
    return clusters.carried_header(lines, F.col("line").startswith("signup"), F.floor(F.col("ord") / 1000)).select("ord", "line", "header")


@query
def gene_counts_window(spark, sf_dir):
    """The streaming aggregation over a batch of events."""
    return gene_counts_by_window(table(spark, sf_dir, "events").withColumnRenamed("event_type", "gene"))


@query
def status_counts(spark, sf_dir):
    return filters.status_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


from . import file_queries  # noqa: E402, F401  its queries are registered here too
