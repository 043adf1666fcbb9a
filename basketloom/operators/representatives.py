"""Representatives of linked baskets: one basket stands for each clique of similar ones, in rounds.

In a round the maximal cliques are taken in order (most baskets first, then by name).  Of a clique's baskets that are
not redundant yet, the one with most domains is chosen, then the one with the least degree, then the smallest id; the
others become redundant.  The next round works on the graph of the chosen ones, until it has no edge.

Baskets of one class (alike in domains and pairs) have the same neighbours, so a class is one node: its best basket may
be chosen, and all the others go to whoever is chosen in the first clique that holds the class.

Components of up to ``LOCAL`` edges are worked out by a task each.  Larger ones are spread over all tasks:

* Maximal cliques are found from each node's edges to nodes of higher degree (no more than the root of twice the number
  of edges) and kept if no other clique, met at their rarest node, holds them.
* Choosing: a clique is decided once it comes first for all its open nodes, so all such cliques are decided at once;
  nodes that became redundant leave the cliques that are left.  When few are ready, the next ``LOCAL`` rows of the
  order are worked through by one task instead, so that a long chain does not take a round for each link.
* What the chosen ones take over from earlier rounds follows from the order in which they were first chosen.

No edge gives no rows here; repeated and turned edges are one.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cliques import maximal_cliques
from .lineage import cut, numbered
from .modules import directed

#: Edges of a component, or rows (clique, node) of a stretch of the order, that one task works through.
LOCAL = 200_000

STANDS = "rep string, member string, class_id string"
#: What a node is: the basket that may be chosen, its domains, how many baskets the node holds.
Node = tuple[str, int, int]


def _take_over(total: dict[str, set], chosen: dict[str, set]) -> None:
    """A chosen one that stands for others already takes over what those stand for whom it now stands for."""
    for rep, members in chosen.items():
        if rep in total:
            total[rep] = set().union(*[total.pop(m) for m in members if m in total])
        else:
            total[rep] = members


def of_classes(edges: list[tuple[str, str]], nodes: dict[str, Node]) -> dict[str, set]:
    """What each chosen basket stands for: baskets, and (class,) for all baskets of a class."""
    total: dict[str, set] = {}
    first = True
    while edges:
        degree = Counter()
        for a, b in edges:
            degree[a] += nodes[b][2]
            degree[b] += nodes[a][2]
        cliques = sorted(map(sorted, maximal_cliques(edges)), key=lambda c: (-sum(nodes[m][2] for m in c), c))
        chosen: dict[str, set] = {}
        redundant, met = set(), set()
        for clique in cliques:
            left = [m for m in clique if m not in redundant]
            if left:
                best = min(left, key=lambda m: (-nodes[m][1], degree[m] + nodes[m][2], nodes[m][0]))
                found = chosen.setdefault(nodes[best][0], set())
                found.update(nodes[m][0] for m in left)
                if first:
                    found.update((m,) for m in left if m not in met and nodes[m][2] > 1)
                    met.update(left)
                redundant.update(m for m in left if m != best)
        _take_over(total, chosen)
        edges = [(nodes[a][0], nodes[b][0]) for a, b in edges if nodes[a][0] in chosen and nodes[b][0] in chosen]
        nodes = {rep: (rep, n, 1) for rep, n, _ in nodes.values()}
        first = False
    return total


def clique_members(edges: DataFrame) -> DataFrame:
    """(members): the maximal cliques of edges (u, v), u < v, as sorted arrays."""
    from .similarity import salted, with_held

    weighted = edges.select(F.col("u").alias("g1"), F.col("v").alias("g2"), F.lit(0.0).alias("pval"))
    out = cut(directed(weighted).select("u", "v"))
    wedges = out.withColumnRenamed("v", "x").join(out.withColumnRenamed("v", "y"), "u").filter("x < y")
    closed = wedges.join(edges.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"], "left_semi")
    rows = out.select("u", F.col("v").alias("x"), F.lit(None).cast("string").alias("y")).unionByName(closed.select("u", "x", "y"))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        u, lone = part["u"].iloc[0], part["y"].isna()
        found = maximal_cliques(zip(part["x"][~lone], part["y"][~lone]), part["x"][lone])
        return pd.DataFrame({"members": [sorted({u} | c) for c in found]})

    found = cut(rows.groupBy("u").applyInPandas(work, "members array<string>"))
    index = with_held(found.select("members", F.explode("members").alias("e")))
    rarest = index.groupBy("members").agg(F.min(F.struct("held", "e")).alias("x")).select("members", "x.e", "x.held")
    small = salted(rarest, True, "members").select("e", "salt", "members")
    large = salted(index, False, "members").select("e", "salt", F.col("members").alias("of"))
    within = small.join(large, ["e", "salt"]).filter((F.size("of") > F.size("members")) & (F.size(F.array_except("members", "of")) == 0))
    return found.join(within.select("members").distinct(), "members", "left_anti")


_PICKS = "ord long, by string, node string"


def _in_order(part: pd.DataFrame) -> pd.DataFrame:
    """Picks of a stretch of cliques, one after the other."""
    out, redundant = [], set()
    for ord_, clique in part.sort_values(["ord", "node"]).groupby("ord", sort=True):
        left = [r for r in clique.itertuples(index=False) if r.node not in redundant]
        if left:
            best = min(left, key=lambda r: (-r.n, r.degree, r.rep)).node
            out += [(ord_, best, r.node) for r in left]
            redundant.update(r.node for r in left if r.node != best)
    return pd.DataFrame(out, columns=["ord", "by", "node"])


def picks(rows: DataFrame) -> DataFrame:
    """(ord, by, node): the open nodes of each clique at its turn, and which of them is chosen; rows are (ord, node, rep, n, degree)."""
    found, rows = [], cut(rows)
    while not rows.isEmpty():
        first = rows.groupBy("node").agg(F.min("ord").alias("first"))
        ready = cut(rows.join(first, "node").groupBy("ord").agg(F.bool_and(F.col("first") == F.col("ord")).alias("ready")).filter("ready").select("ord"))
        now = cut(rows.join(ready, "ord", "left_semi"))
        if now.limit(LOCAL).count() < LOCAL:
            # Few are ready: the next stretch of the order instead, whole cliques of it.
            stretch = rows.select("ord").orderBy("ord").limit(LOCAL + 1)
            n, low, high = stretch.agg(F.count(F.lit(1)), F.min("ord"), F.max("ord")).first()
            last = high if n <= LOCAL else max(low, high - 1)
            got = cut(rows.filter(F.col("ord") <= last).withColumn("stretch", F.lit(0)).groupBy("stretch").applyInPandas(_in_order, _PICKS))
            rows = rows.filter(F.col("ord") > last)
        else:
            best = now.groupBy("ord").agg(F.min(F.struct((-F.col("n")).alias("n"), "degree", "rep", "node"))["node"].alias("by"))
            got = cut(now.join(best, "ord").select("ord", "by", "node"))
            rows = rows.join(ready, "ord", "left_anti")
        found.append(got)
        rows = cut(rows.join(got.filter("node <> by").select("node").distinct(), "node", "left_anti"))
    return reduce(DataFrame.union, found)


def _followed(rows: DataFrame, known: str) -> DataFrame:
    """Resolves column ``known`` along pointers ``to`` until no row changes; rows are (node, to, known), nodes without ``to`` are resolved."""
    while True:
        of = rows.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col(known).alias("there"))
        step = cut(rows.join(of, "to", "left").select("node", F.col("next").alias("to"), F.coalesce("there", known).alias(known)))
        if step.filter("to is not null").isEmpty():
            return step
        rows = step


def _active(chosen: DataFrame) -> DataFrame:
    """Chosen ones that take over: they stand for others already, unless one chosen before them that takes over stands for them now."""
    rows = cut(chosen.select("node", F.when(F.col("parent_ord") < F.col("ord"), F.col("parent")).alias("before"), "held"))
    done = cut(rows.filter("before is null or not held").select("node", F.col("held").alias("active")))
    open_ = cut(rows.filter("before is not null and held").select("node", "before"))
    while not open_.isEmpty():
        step = cut(open_.join(done.select(F.col("node").alias("before"), "active"), "before", "left"))
        done = cut(done.union(step.filter("active is not null").select("node", ~F.col("active"))))
        open_ = cut(step.filter("active is null").select("node", "before"))
    return done.filter("active").select("node")


def _merged(total: DataFrame, picked: DataFrame) -> DataFrame:
    """``_take_over`` of a later round, whose nodes are baskets; total is (rep, member, class_id)."""
    first = picked.groupBy("by").agg(F.min("ord").alias("ord"))
    parent = picked.filter("node <> by").select("node", F.col("by").alias("parent")).distinct()  # one at most
    keys = total.select(F.col("rep").alias("node")).distinct().withColumn("held", F.lit(True))
    chosen = first.withColumnRenamed("by", "node").join(parent, "node", "left").join(first.select(F.col("by").alias("parent"), F.col("ord").alias("parent_ord")), "parent", "left")
    chosen = cut(chosen.join(keys, "node", "left").select("node", "ord", "parent", "parent_ord", F.coalesce("held", F.lit(False)).alias("held")))
    active = cut(_active(chosen).withColumn("active", F.lit(True)))
    state = chosen.join(active, "node", "left").join(active.select(F.col("node").alias("parent"), F.col("active").alias("parent_active")), "parent", "left")
    state = cut(state.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("active", "parent_active")}))
    up = F.when(F.col("parent_active") & (F.col("parent_ord") > F.col("ord")), F.col("parent"))
    roots = _followed(state.select("node", up.alias("to"), F.coalesce(up, F.col("node")).alias("root")), "root").select("node", "root")
    # Where the set of an earlier one goes first: to itself if it takes over, else to the one that stands for it.
    others = parent.join(chosen.select("node"), "node", "left_anti").join(active.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.col("parent").alias("goes"))
    goes = state.filter("held").select("node", F.when(F.col("active"), F.col("node")).otherwise(F.col("parent")).alias("goes")).union(others.select("node", "goes"))
    goes = goes.join(roots.withColumnRenamed("node", "goes"), "goes").select(F.col("node").alias("rep"), "root")
    kept = total.join(goes, "rep", "left").select(F.coalesce("root", "rep").alias("rep"), "member", "class_id")
    bare = picked.join(state.filter("not active").select(F.col("node").alias("by")), "by", "left_semi").join(roots.withColumnRenamed("node", "by"), "by")
    bare = bare.select(F.col("root").alias("rep"), F.col("node").alias("member"), F.lit(None).cast("string").alias("class_id"))
    return kept.unionByName(bare).distinct()


def distributed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, member, class_id) as ``of_classes`` has it; nodes are (node, rep, n, weight), edges (u, v)."""
    total, nodes = None, cut(nodes)
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct())
    while not edges.isEmpty():
        ends = edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("v", "u"))
        degree = ends.join(nodes.select(F.col("node").alias("other"), "weight"), "other").groupBy("node").agg(F.sum("weight").alias("degree"))
        about = nodes.join(degree, "node").withColumn("degree", F.col("degree") + F.col("weight"))
        cliques = clique_members(edges).select("members", F.explode("members").alias("node")).join(about, "node")
        sized = cliques.groupBy("members").agg(F.sum("weight").alias("size"), F.collect_list(F.struct("node", "rep", "n", "degree")).alias("x"))
        rows = numbered(sized, "ord", F.desc("size"), "members").select("ord", F.explode("x").alias("x")).select("ord", "x.*")
        picked = cut(picks(rows))
        if total is None:
            names = nodes.select("node", "rep", "weight")
            named = picked.join(names, "node").join(names.select(F.col("node").alias("by"), F.col("rep").alias("by_rep")), "by")
            first = named.filter("weight > 1").groupBy("node").agg(F.min_by("by_rep", "ord").alias("rep"))
            total = named.select(F.col("by_rep").alias("rep"), F.col("rep").alias("member"), F.lit(None).cast("string").alias("class_id")).distinct()
            total = cut(total.unionByName(first.select("rep", F.lit(None).cast("string").alias("member"), F.col("node").alias("class_id"))))
        else:
            total = cut(_merged(total, picked))
        left = picked.select(F.col("by").alias("node")).distinct().join(nodes.select("node", "rep"), "node")
        one, two = left.select(F.col("node").alias("u"), F.col("rep").alias("a")), left.select(F.col("node").alias("v"), F.col("rep").alias("b"))
        edges = cut(edges.join(one, "u").join(two, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))
        nodes = cut(nodes.select(F.col("rep").alias("node"), "rep", "n", F.lit(1).cast("long").alias("weight")))
    return total if total is not None else edges.sparkSession.createDataFrame([], STANDS)


def of_graph(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """(rep, member, class_id) of all nodes with edges; components are (node, component)."""
    placed = cut(edges.join(components.withColumnRenamed("node", "u"), "u"))
    large = placed.groupBy("component").count().filter(F.col("count") > LOCAL).select("component")
    info = lambda k: nodes.select(F.col("node").alias(k), F.struct("rep", "n", "weight").alias(f"{k}_is"))
    rows = placed.join(large, "component", "left_anti").join(info("u"), "u").join(info("v"), "v")

    def work(part: pd.DataFrame) -> pd.DataFrame:
        known = {k: (i["rep"], i["n"], i["weight"]) for a in "uv" for k, i in zip(part[a], part[f"{a}_is"])}
        found = of_classes(sorted(set(zip(part["u"], part["v"]))), known)
        out = [(rep, *((None, m[0]) if isinstance(m, tuple) else (m, None))) for rep, members in found.items() for m in sorted(members, key=str)]
        return pd.DataFrame(out, columns=["rep", "member", "class_id"])

    found = rows.groupBy("component").applyInPandas(work, STANDS)
    if large.isEmpty():
        return found
    return found.unionByName(distributed(nodes, placed.join(large, "component", "left_semi").select("u", "v")))
