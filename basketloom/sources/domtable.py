"""Domain tables of profile searches (domtblout), to baskets and domain hits.

Lines that begin with ``#`` are comments; columns are set apart by white space, the last one is free text.  The
query names a gene: ``<bgc>_gid:<gene>_pid:<protein>_loc:<start>;<end>;<strand>_<i>/<n>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketloom.functions.genes import EMPTY
from basketloom.operators.overlap import survivors

#: Columns of a line by position: name, place, type.
COLUMNS = (("domain", 0, "string"), ("query", 3, "string"), ("bitscore", 13, "double"), ("ali_from", 17, "int"), ("ali_to", 18, "int"))
#: How a query ends: the gene's number and how many the table has.
_PLACE = "^[0-9]+/[0-9]+$"


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, ord, domain, query, bitscore, q_start, q_end); cluster_id is the file name without its ending."""
    rows = spark.read.text(path, pathGlobFilter="*.domtable") if not path.endswith(".domtable") else spark.read.text(path)
    stem = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    rows = rows.select(F.url_decode(F.regexp_replace(stem, r"\+", "%2B")).alias("cluster_id"), F.monotonically_increasing_id().alias("ord"), F.trim("value").alias("line"))
    return parse_rows(rows)


def parse_rows(rows: DataFrame) -> DataFrame:
    """The same from (cluster_id, ord, line)."""
    rows = rows.filter(~F.col("line").startswith("#") & (F.col("line") != ""))
    parts = F.split("line", r"\s+", 23)
    rows = rows.select("cluster_id", "ord", *(F.get(parts, F.lit(k)).try_cast(kind).alias(name) for name, k, kind in COLUMNS))
    return rows.select("cluster_id", "ord", "domain", "query", "bitscore", (F.col("ali_from") - 1).alias("q_start"), F.col("ali_to").alias("q_end"))


def with_gene(rows: DataFrame) -> DataFrame:
    """Adds bgc, g_id, p_id, location, orf_num, tot_orf; the numbers and bgc are null if the query cannot be read."""
    # A name with "_gid" in it more than once cannot be taken apart for certain.
    before, after = F.substring_index("query", "_gid", 1), F.substring_index("query", "_gid", -1)
    info = F.split(after, "_")
    place = F.when(F.length(before) + F.length(after) + 4 == F.length("query"), F.substring_index(after, "_", -1))
    place = F.when(place.rlike(_PLACE) & (F.size(info) > 1), place)
    # What follows the last colon of each of the first fields; the last field is the place.
    field = lambda k: F.when(F.size(info) > k + 1, F.substring_index(F.get(info, F.lit(k)), ":", -1))
    return rows.withColumns({
        "orf_num": F.substring_index(place, "/", 1).try_cast("int"), "tot_orf": F.substring_index(place, "/", -1).try_cast("int"),
        "bgc": F.when(place.isNotNull(), before), **{name: F.coalesce(field(k), F.lit("")) for k, name in enumerate(("g_id", "p_id", "location"))},
    })


def hits(rows: DataFrame, max_overlap: float = 0.1) -> DataFrame:
    """Domain hits that survive the overlap rule, of clusters all of whose rows can be read.

    Of each gene and domain only the first line counts.  Columns: cluster_id, ord, bgc, g_id, p_id, location,
    orf_num, tot_orf, domain, q_start, q_end, bitscore.
    """
    unread = F.col("orf_num").isNull() | F.col("bitscore").isNull() | F.col("q_start").isNull() | F.col("q_end").isNull()
    rows = with_gene(rows).select(*rows.columns, unread.alias("_unread"))
    # One shuffle and one sort serve both windows and the lists of genes; a query is taken apart again where it is left.
    lines = Window.partitionBy("cluster_id").orderBy("query", "domain", "ord")
    broken = F.max("_unread").over(lines.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_broken", broken).withColumn("_nth", F.row_number().over(Window.partitionBy("cluster_id", "query", "domain").orderBy("ord")))
    first = rows.filter("not _broken and _nth = 1").drop("_unread", "_broken", "_nth")
    kept = with_gene(survivors(first, ["cluster_id", "query"], "ord", max_overlap))
    return kept.select("cluster_id", "ord", "bgc", "g_id", "p_id", "location", "orf_num", "tot_orf", "domain", "q_start", "q_end", "bitscore")


def clusters(found: DataFrame) -> DataFrame:
    """(bgc_id, pos, gene) from domain hits: gene numbers without hits are empty genes."""
    genes = found.groupBy("cluster_id", "orf_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("q_start", "ord", "domain"))), lambda x: x["domain"]), ";").alias("gene"))
    spans = found.groupBy("cluster_id").agg(F.greatest(F.max("tot_orf"), F.max("orf_num")).alias("n"))
    slots = spans.select("cluster_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("orf_num"))
    out = slots.join(genes, ["cluster_id", "orf_num"], "left")
    return out.select(F.col("cluster_id").alias("bgc_id"), (F.col("orf_num") - 1).alias("pos"), F.coalesce("gene", F.lit(EMPTY)).alias("gene"))


def tokenised(spark: SparkSession, path: str, max_overlap: float = 0.1, min_genes: int = 2) -> tuple[DataFrame, DataFrame]:
    """(baskets, hits) of all ``*.domtable`` files of a folder; baskets with too few genes are left out, always."""
    from basketloom.operators.filters import having_genes

    found = hits(read_rows(spark, path), max_overlap)
    return having_genes(clusters(found), min_genes), found


def in_order(found: DataFrame) -> DataFrame:
    """Hits as they are written: by cluster, gene number and start."""
    place = Window.partitionBy("cluster_id").orderBy("orf_num", "q_start", "ord")
    return found.withColumn("place", F.row_number().over(place)).orderBy("cluster_id", "place").drop("place")
