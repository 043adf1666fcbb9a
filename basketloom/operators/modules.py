"""Modules: significant groups of genes, as maximal cliques of the interaction graph.

A set of three genes or more is a module if it is a maximal clique at some p-value cut-off.  Its strictest cut-off
is the largest p-value within it: there it is a clique for the first time, and if it is not maximal there, a larger
cut-off does not make it so.  Hence the modules are found edge by edge: with w the edge's p-value, the maximal
cliques among the common neighbours by edges up to w, together with the edge, are the modules whose strictest
cut-off is w.  No cut-off is swept, and every edge is a task of its own.

A large graph is worked on through its triangles.  Edges point from the gene of lower degree to that of higher, so
that a hub with many neighbours has few edges going out (no gene more than the root of twice the number of edges); a
triangle is found once, from its lowest gene, and handed to its weakest edges.  An edge's group then holds the
common neighbours that may form a module with it, never a hub's whole neighbourhood.

No edge gives no module; an edge from a gene to itself is left out, and of repeated edges the smallest p-value counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketloom.functions.genes import round_significant
from basketloom.sources.tables import module_sizes

from .cliques import maximal_cliques
from .lineage import cut, numbered

#: A graph of at most this many edges is broadcast; a larger one is worked on by triangles.
BROADCAST_EDGES = 500_000

FOUND = "genes array<string>, strictest_pval double"


def significant(edges: DataFrame, max_pval: float) -> DataFrame:
    return edges.filter(F.col("pval") <= max_pval)


def through_edge(u: str, v: str, w: float, near: dict[str, dict[str, float]]) -> Iterator[list[str]]:
    """Modules whose largest p-value is that of the edge (u, v)."""
    common = [x for x, p in near[u].items() if p <= w and x != v and near[v].get(x, 2.0) <= w]
    inner = [(x, y) for k, x in enumerate(common) for y in common[k + 1 :] if near[x].get(y, 2.0) <= w]
    for clique in maximal_cliques(inner, common):
        yield sorted({u, v} | clique)


def _graph(rows: list[tuple[str, str, float]]) -> dict[str, dict[str, float]]:
    near: dict[str, dict[str, float]] = {}
    for a, b, p in rows:
        near.setdefault(a, {})[b] = p
        near.setdefault(b, {})[a] = p
    return near


def find_modules(edges: DataFrame, digits: int | None = None) -> DataFrame:
    """(genes, strictest_pval) of all modules of the edges (g1, g2, pval); genes are sorted.

    ``digits`` rounds p-values to significant digits first, which merges near cut-offs.
    """
    pval = round_significant(F.col("pval"), digits) if digits else F.col("pval")
    edges = cut(edges.filter("g1 <> g2").groupBy(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2")).agg(F.min(pval).alias("pval")))
    found = _broadcast(edges) if edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES else _by_triangles(edges)
    return found.distinct()


def _broadcast(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(_graph([tuple(r) for r in edges.collect()]))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = shared.value
        for part in parts:
            rows = [(genes, w) for u, v, w in zip(part["g1"], part["g2"], part["pval"]) for genes in through_edge(u, v, w, near)]
            yield pd.DataFrame(rows, columns=["genes", "strictest_pval"])

    return edges.repartition(edges.sparkSession.sparkContext.defaultParallelism * 4, F.xxhash64("g1", "g2")).mapInPandas(work, FOUND)


def directed(edges: DataFrame) -> DataFrame:
    """(u, v, pval): the edges from the gene of lower degree to that of higher, names deciding ties."""
    ends = edges.select(F.col("g1").alias("g")).union(edges.select("g2"))
    degree = ends.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    rows = edges.join(degree.select(F.col("g").alias("g1"), F.col("n").alias("n1")), "g1").join(degree.select(F.col("g").alias("g2"), F.col("n").alias("n2")), "g2")
    low, high = (f(F.struct(F.col("n1").alias("n"), F.col("g1").alias("g")), F.struct(F.col("n2").alias("n"), F.col("g2").alias("g")))["g"] for f in (F.least, F.greatest))
    return rows.select(low.alias("u"), high.alias("v"), "pval")


def common_neighbours(edges: DataFrame, out: DataFrame) -> DataFrame:
    """(g1, g2, w, x): for each edge the genes that both ends are linked to by edges no weaker than it."""
    wedges = out.select("u", F.col("v").alias("g1"), F.col("pval").alias("p1")).join(out.select("u", F.col("v").alias("g2"), F.col("pval").alias("p2")), "u").filter("g1 < g2")
    triangles = wedges.join(edges.withColumnRenamed("pval", "p"), ["g1", "g2"])
    side = lambda a, b, p, x: F.struct(F.least(a, b).alias("g1"), F.greatest(a, b).alias("g2"), F.col(p).alias("w"), F.col(x).alias("x"))
    sides = F.array(side("g1", "g2", "p", "u"), side("u", "g1", "p1", "g2"), side("u", "g2", "p2", "g1"))
    weakest = F.filter(sides, lambda s: s["w"] == F.greatest("p", "p1", "p2"))
    return triangles.select(F.explode(weakest).alias("s")).select("s.*")


def _by_triangles(edges: DataFrame) -> DataFrame:
    """The same from each edge's common neighbours and the edges among them."""
    out = cut(directed(edges))
    third = cut(common_neighbours(edges, out))
    inner = third.join(out.select(F.col("u").alias("x"), F.col("v").alias("y"), "pval"), "x").filter("pval <= w")
    inner = inner.join(third.select("g1", "g2", F.col("x").alias("y")), ["g1", "g2", "y"], "left_semi")
    rows = third.withColumn("y", F.lit(None).cast("string")).unionByName(inner.select("g1", "g2", "w", "x", "y"))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        u, v, w = part["g1"].iloc[0], part["g2"].iloc[0], part["w"].iloc[0]
        lone = part["y"].isna()
        cliques = maximal_cliques(zip(part["x"][~lone], part["y"][~lone]), part["x"][lone])
        return pd.DataFrame([(sorted({u, v} | c), w) for c in cliques], columns=["genes", "strictest_pval"])

    return rows.groupBy("g1", "g2").applyInPandas(work, FOUND)


def with_ids(modules: DataFrame) -> DataFrame:
    """Adds module_id: 1, 2, ... by strictest p-value, then genes."""
    return numbered(modules, "module_id", "strictest_pval", F.array_join("genes", ","))


def contained_in(clusters: DataFrame, modules: DataFrame) -> DataFrame:
    """(bgc_id, genes) for each basket and module all of whose genes it holds; ``genes`` are the module's.

    A basket and a module meet only at the module's rarest gene, then the whole set is compared.
    """
    sets = clusters.select("bgc_id", F.array_distinct("genes").alias("held"))
    known = modules.select("genes").distinct()
    counts = sets.select(F.explode("held").alias("gene")).groupBy("gene").count()
    anchors = known.select("genes", F.explode("genes").alias("gene")).join(counts, "gene", "left")
    anchors = anchors.groupBy("genes").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "gene")).alias("m")).select("genes", F.col("m.gene").alias("gene"))
    met = sets.select("bgc_id", "held", F.explode("held").alias("gene")).join(anchors, "gene")
    return met.filter(F.forall("genes", lambda g: F.array_contains("held", g))).select("bgc_id", "genes")


def occurrences(clusters: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules with ``occurences``: the number of baskets that hold them."""
    counts = contained_in(clusters, modules).groupBy("genes").agg(F.count(F.lit(1)).alias("occurences"))
    base = modules.drop("occurences")
    return base.join(counts, "genes", "left").withColumn("occurences", F.coalesce("occurences", F.lit(0)).cast("long"))


def filter_infrequent(modules: DataFrame, least: int = 2) -> DataFrame:
    """Modules with at least ``least`` occurrences, numbered anew."""
    return with_ids(modules.drop("module_id").filter(F.col("occurences") >= least))


def build_modules(masked: DataFrame, max_pval: float, digits: int | None = None) -> DataFrame:
    """All modules of baskets whose infrequent genes are masked, with ids, sizes and occurrences; none if no edge holds."""
    from .pvalues import interaction_edges

    found = find_modules(significant(interaction_edges(masked), max_pval), digits)
    return module_sizes(with_ids(occurrences(masked, found)))


def detect(clusters: DataFrame, modules: DataFrame) -> DataFrame:
    """(bgc_id, module_id, genes) of modules found in baskets."""
    found = contained_in(clusters, modules)
    return found.join(modules.select("module_id", "genes"), "genes").select("bgc_id", "module_id", "genes")


def detected_ids(clusters: DataFrame, detected: DataFrame) -> DataFrame:
    """(bgc_id, module_ids) of every basket; empty text for none."""
    ids = detected.groupBy("bgc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("module_id")), lambda x: x.cast("string")), ",").alias("module_ids"))
    return clusters.select("bgc_id").distinct().join(ids, "bgc_id", "left").withColumn("module_ids", F.coalesce("module_ids", F.lit("")))


def detected_blocks(clusters: DataFrame, detected: DataFrame) -> DataFrame:
    """(bgc_id, value): text blocks, ``>bgc`` and one line for each module."""
    line = F.concat_ws("\t", F.col("module_id").cast("string"), F.array_join("genes", ","))
    lines = detected.groupBy("bgc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("module_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    rows = clusters.select("bgc_id").distinct().join(lines, "bgc_id", "left")
    return rows.select("bgc_id", F.concat_ws("\n", F.concat(F.lit(">"), "bgc_id"), "lines").alias("value"))
