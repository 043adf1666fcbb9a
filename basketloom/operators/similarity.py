"""Similar baskets and their representatives.

Two baskets are linked if their adjacency index exceeds the cut-off or the domains of one contain those of the
other.  Baskets with the same domains and the same adjacent pairs are one class; links are sought between classes,
so copies cost no pairs.

* Containment: a set and those that contain it meet at its rarest domain.
* Adjacency index: with elements in order of rarity, two sets whose index exceeds the cut-off share an element among
  the first few of each (all but the share of the cut-off); sizes and places bound what they can share.

Pairs that meet are compared by 64-bit signatures and these bounds where they meet; only what passes is joined with
the whole sets.  The class without any domain is contained in every other one: a row for each class.

Nulls, empty tables and odd rows: empty baskets are the class just named; no basket gives no rows; repeated ids are one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketloom.functions.genes import adjacency_index, adjacent_pairs, contains_either, domain_set

from .cliques import maximal_cliques
from .lineage import cut, drop

#: Index rows of an element that one task may hold, and tasks that it is dealt to at most.
PER_SALT, SALTS = 50_000, 64
#: Slack for sizes times a cut-off in doubles; it can only let more pairs through to the exact comparison.
SLACK = 1e-9


def features(clusters: DataFrame) -> DataFrame:
    """(bgc_id, domains, pairs): sets of domains and of adjacent pairs."""
    return clusters.select("bgc_id", domain_set(F.col("genes")).alias("domains"), adjacent_pairs(F.col("genes")).alias("pairs"))


def salted(rows: DataFrame, copied: bool, key: str = "class_id") -> DataFrame:
    """Adds ``salt``: elements held by many rows are dealt to several tasks, and repeated for each on the other side."""
    salts = F.least(F.lit(SALTS), F.ceil(F.col("held") / PER_SALT)).cast("int")
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)) if copied else F.pmod(F.xxhash64(key), salts).cast("int"))


def with_held(index: DataFrame) -> DataFrame:
    """Adds ``held``: how many rows of the index hold the element."""
    return index.join(index.groupBy("e").agg(F.count(F.lit(1)).alias("held")), "e")


def _shared(sets: DataFrame, column: str) -> DataFrame:
    """(class_id, e, held, n, place): those elements of each set that other sets hold too, with its size, rarest first.

    Places count from 0 over all elements; those of one set alone come first.
    """
    index = sets.select("class_id", F.size(column).alias("n"), F.explode(F.transform(column, lambda x: F.xxhash64(x))).alias("e"))
    often = index.groupBy("e").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    by_set = index.join(often, "e").groupBy("class_id", "n").agg(F.sort_array(F.collect_list(F.struct("held", "e"))).alias("es"))
    rows = by_set.select("class_id", "n", (F.col("n") - F.size("es")).alias("own"), F.posexplode("es").alias("k", "x"))
    return rows.select("class_id", "x.e", "x.held", "n", (F.col("own") + F.col("k")).alias("place"))


def _signature(column: str) -> Column:
    """A bit for each element; a set within another has no bit that the other lacks."""
    return F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))))


def contained_candidates(sets: DataFrame) -> DataFrame:
    """(a, b), a < b: classes of which one may hold the other's domains, met at the rarest domain of the smaller."""
    sized = ("class_id", "n", "bits")
    hashed = sets.select("class_id", F.transform("domains", lambda x: F.xxhash64(x)).alias("domains"))
    index = with_held(hashed.select("class_id", F.size("domains").alias("n"), _signature("domains").alias("bits"), F.explode("domains").alias("e")))
    rarest = index.groupBy(*sized).agg(F.min(F.struct("held", "e")).alias("x")).select(*sized, "x.e", "x.held")
    small = salted(rarest, True).select("e", "salt", *(F.col(c).alias(f"a_{c}") for c in sized))
    large = salted(index, False).select("e", "salt", *(F.col(c).alias(f"b_{c}") for c in sized))
    smaller = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_class_id") < F.col("b_class_id")))
    met = small.join(large, ["e", "salt"]).filter(smaller & (F.col("a_bits").bitwiseAND(F.bitwise_not(F.col("b_bits"))) == 0))
    return met.select(F.least("a_class_id", "b_class_id").alias("a"), F.greatest("a_class_id", "b_class_id").alias("b"))


def adjacent_candidates(sets: DataFrame, cutoff: float) -> DataFrame:
    """(a, b), a < b: classes whose adjacency index may exceed the cut-off, met within the prefixes of their pairs."""
    prefix = _shared(sets, "pairs").filter(F.col("place") < F.col("n") - F.floor(F.col("n") * cutoff - SLACK))
    one = salted(prefix, False).select("e", "salt", *(F.col(c).alias(f"a_{c}") for c in ("class_id", "n", "place")))
    two = salted(prefix, True).select("e", "salt", *(F.col(c).alias(f"b_{c}") for c in ("class_id", "n", "place")))
    near = F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * cutoff - SLACK
    # From the first shared element on, no more is left to share.
    most = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
    enough = most >= (F.col("a_n") + F.col("b_n")) * (cutoff / (1 + cutoff)) - SLACK
    met = one.join(two, ["e", "salt"]).filter((F.col("a_class_id") < F.col("b_class_id")) & near & enough)
    return met.select(F.col("a_class_id").alias("a"), F.col("b_class_id").alias("b")).distinct()


def _measured(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, ai, contained) of pairs of classes, from their whole sets; without pairs ``ai`` is null."""
    known = [c for c in (("class_id", ""), ("domains", "_d"), ("pairs", "_p")) if c[0] in sets.columns]
    side = lambda k: sets.select(*(F.col(c).alias(k + n) for c, n in known))
    rows = candidates.join(side("a"), "a").join(side("b"), "b")
    ai = adjacency_index(F.col("a_p"), F.col("b_p")) if "pairs" in sets.columns else F.lit(None).cast("double")
    return rows.select("a", "b", ai.alias("ai"), contains_either(F.col("a_d"), F.col("b_d")).alias("contained"))


@dataclass(frozen=True)
class Links:
    """Classes of baskets and the links between them.

    ``members`` is (bgc_id, class_id), the class named by its smallest id; ``classes`` (class_id, size, ai, contained):
    its baskets and how any two of them compare; ``edges`` (a, b, ai, contained) between classes, a < b.
    """

    members: DataFrame
    classes: DataFrame
    edges: DataFrame

    def pairs(self) -> DataFrame:
        """(bgc1, bgc2, ai, contained) of all linked baskets, bgc1 < bgc2: as many rows as there are such pairs."""
        one, two = self.members.select(F.col("bgc_id").alias("x"), F.col("class_id").alias("a")), self.members.select(F.col("bgc_id").alias("y"), F.col("class_id").alias("b"))
        across = self.edges.join(one, "a").join(two, "b")
        within = self.classes.filter("size > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), "ai", "contained").join(one, "a").join(two, "b").filter("x < y")
        return across.unionByName(within).select(F.least("x", "y").alias("bgc1"), F.greatest("x", "y").alias("bgc2"), "ai", "contained")

    def linked_classes(self) -> DataFrame:
        """(class_id): classes with a link or of several linked baskets."""
        alone = self.classes.filter("size > 1 AND contained").select("class_id")
        return self.edges.select(F.col("a").alias("class_id")).union(self.edges.select("b")).union(alone).distinct()

    def unlinked(self) -> DataFrame:
        """(bgc_id) of the baskets without a link."""
        return self.members.join(self.linked_classes(), "class_id", "left_anti").select("bgc_id")

    def components(self) -> DataFrame:
        """(bgc_id, component) of linked baskets: the smallest id that each reaches."""
        rows = self.members.join(self.linked_classes(), "class_id")
        found = connected(self.edges, "a", "b").withColumnRenamed("bgc_id", "class_id")
        return rows.join(found, "class_id", "left").select("bgc_id", F.coalesce("component", "class_id").alias("component"))


def links(clusters: DataFrame, cutoff: float | None = 0.95, contained: bool = True) -> Links:
    """Links of baskets; no cut-off leaves the adjacency index out, ``contained`` false leaves containment out.

    Without the index, classes are of baskets with the same domains, no pair is worked out, and ``ai`` is null.
    """
    of = ("domains",) if cutoff is None else ("domains", "pairs")
    key = F.md5(F.concat(*(F.md5(F.array_join(F.sort_array(c), "\x1f")) for c in of)))
    rows = cut(features(clusters).select("bgc_id", *of, F.unhex(key).alias("key")))
    # Each step is a table of its own, whose shuffle files are gone before the next begins.
    keyed = cut(rows.groupBy("key").agg(F.min("bgc_id").alias("class_id"), *(F.first(c).alias(c) for c in of)))
    members = cut(rows.select("key", "bgc_id").join(keyed.select("key", "class_id"), "key").select("key", "bgc_id", "class_id").distinct().select("bgc_id", "class_id"))
    drop(rows)
    sets = keyed.drop("key")
    candidates = [cut(contained_candidates(sets))] if contained else []
    if cutoff is not None:
        candidates.append(cut(adjacent_candidates(sets, cutoff)))
    found = candidates[0] if len(candidates) == 1 else candidates[0].union(candidates[1]).distinct()
    by_index = F.col("ai") > (2.0 if cutoff is None else cutoff)
    edges = _measured(sets, found).filter((F.col("contained") & F.lit(contained)) | by_index)
    if contained:
        none = sets.filter(F.size("domains") == 0).select(F.col("class_id").alias("x"))  # one row at most
        every = sets.filter(F.size("domains") > 0).select(F.col("class_id").alias("y")).join(F.broadcast(none))
        edges = edges.unionByName(every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(None if cutoff is None else 0.0).cast("double").alias("ai"), F.lit(True).alias("contained")))
    alike = F.lit(None).cast("double") if cutoff is None else F.when(F.size("pairs") > 0, F.lit(1.0)).otherwise(0.0)
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("size"))
    classes = sizes.join(sets.select("class_id", alike.alias("ai")), "class_id").select("class_id", "size", "ai", F.lit(contained).alias("contained"))
    if not contained:
        classes = classes.withColumn("size", F.when(F.col("ai") > cutoff, F.col("size")).otherwise(1)).withColumn("contained", F.lit(True))
    edges = cut(edges)
    for table in candidates:
        drop(table)
    return Links(members, classes, edges)


def pair_measures(clusters: DataFrame) -> DataFrame:
    """(bgc1, bgc2, ai, contained) of all pairs that share an adjacent pair, or of which one contains the other."""
    return links(clusters, 0.0).pairs()


def similarity_edges(clusters: DataFrame, cutoff: float = 0.95) -> DataFrame:
    """(bgc1, bgc2, ai, contained) of linked baskets, bgc1 < bgc2."""
    return links(clusters, cutoff).pairs()


def unlinked(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """Baskets without an edge."""
    ends = edges.select(F.col("bgc1").alias("bgc_id")).union(edges.select(F.col("bgc2").alias("bgc_id"))).distinct()
    return clusters.join(ends, "bgc_id", "left_anti")


def connected(edges: DataFrame, a: str = "bgc1", b: str = "bgc2") -> DataFrame:
    """(bgc_id, component): the smallest id that each end of an edge reaches, by label propagation.

    Each round takes the smallest label of the neighbours, then the label of that label.  Rounds are cut by
    ``checkpoint`` where the session has a checkpoint folder and by caching where it has none.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = cut(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v")).alias("c")))
    while True:
        near = both.join(labels, both["v"] == labels["id"]).groupBy(F.col("u").alias("id")).agg(F.min("c").alias("near"))
        step = labels.join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        step = step.join(labels.select(F.col("id").alias("c"), F.col("c").alias("far")), "c", "left")
        step = cut(step.select("id", "old", F.least("c", "far").alias("c")))
        if step.filter("c < old").isEmpty():
            return step.select(F.col("id").alias("bgc_id"), F.col("c").alias("component"))
        labels = step.select("id", "c")


def choose(cliques: list[list[str]], sizes: dict[str, int], degree: dict[str, int]) -> dict[str, set[str]]:
    """What each chosen basket stands for after one round over the cliques, in their order.

    Of a clique's members that are not redundant yet, the one with most domains is chosen, then the one with the
    least degree, then the smallest id; the others become redundant.  A basket chosen earlier may become
    redundant later in the round and keeps what it stands for.
    """
    found: dict[str, set[str]] = {}
    redundant: set[str] = set()
    for clique in cliques:
        left = [m for m in clique if m not in redundant]
        if left:
            rep = min(left, key=lambda m: (-sizes[m], degree[m], m))
            found.setdefault(rep, set()).update(left)
            redundant.update(m for m in left if m != rep)
    return found


def representatives_of(edges: list[tuple[str, str]], sizes: dict[str, int]) -> dict[str, set[str]]:
    """Rounds of ``choose`` on the graph of the chosen ones, until it has no edge; then all that each stands for."""
    total: dict[str, set[str]] = {}
    while edges:
        degree = Counter(end for edge in edges for end in edge)
        cliques = sorted(map(sorted, maximal_cliques(edges)), key=lambda c: (-len(c), c))
        chosen = choose(cliques, sizes, degree)
        for rep, members in chosen.items():
            if rep in total:  # it takes over from those that it now stands for
                taken = [total.pop(m) for m in members if m in total]
                total[rep] = set().union(*taken)
            else:
                total[rep] = members
        edges = [(a, b) for a, b in edges if a in chosen and b in chosen]
    return total


def representatives(clusters: DataFrame, links: Links) -> DataFrame:
    """(rep, member): baskets that stand for others (and themselves); baskets without a link stand for themselves."""
    from .filters import domains_per_basket
    from .representatives import of_graph
    from basketloom.sources.clusters import exploded

    sizes = domains_per_basket(exploded(clusters)).groupBy("bgc_id").agg(F.max("n_domains").alias("n"))
    known = links.members.join(sizes, "bgc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    best = known.groupBy("class_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "bgc_id", "n")).alias("best"), F.count(F.lit(1)).alias("weight"))
    nodes = cut(best.select(F.col("class_id").alias("node"), F.col("best.bgc_id").alias("rep"), F.col("best.n").alias("n"), "weight"))
    edges = links.edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = of_graph(nodes, edges, connected(links.edges, "a", "b").select(F.col("bgc_id").alias("node"), "component"))
    ends = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    alone = nodes.join(ends, "node", "left_anti").select("rep", F.lit(None).cast("string").alias("member"), F.col("node").alias("class_id"))
    found = found.unionByName(alone)
    classes = found.filter("member is null").select("rep", "class_id").join(links.members, "class_id").select("rep", F.col("bgc_id").alias("member"))
    return found.filter("member is not null").select("rep", "member").union(classes).distinct()


def filter_similar(clusters: DataFrame, cutoff: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(representative baskets, (rep, member) table)."""
    members = representatives(clusters, links(clusters, cutoff))
    return clusters.join(members.select(F.col("rep").alias("bgc_id")).distinct(), "bgc_id", "left_semi"), members
