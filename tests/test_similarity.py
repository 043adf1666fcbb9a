"""Similarity edges and representatives against brute force."""

import random
from itertools import combinations

from basketloom.operators import similarity
from basketloom.operators.cliques import maximal_cliques


def frame(spark, baskets):
    return spark.createDataFrame(list(baskets.items()), "bgc_id string, genes array<string>")


def brute(baskets):
    def sets(genes):
        flat = [d for g in genes for d in g.split(";")]
        return {d for d in flat if d != "-"}, {tuple(sorted(p)) for p in zip(flat, flat[1:]) if "-" not in p}

    out = {}
    for a, b in combinations(sorted(baskets), 2):
        (da, pa), (db, pb) = sets(baskets[a]), sets(baskets[b])
        ai = len(pa & pb) / len(pa | pb) if pa and pb else 0.0
        if da <= db or db <= da or ai > 0.5:
            out[a, b] = (ai, da <= db or db <= da)
    return out


def test_known_edges(spark):
    rows = similarity.pair_measures(frame(spark, {"1": ["A", "B"], "2": ["A", "B;C"]})).collect()
    assert [(r.bgc1, r.bgc2, r.ai, r.contained) for r in rows] == [("1", "2", 0.5, True)]
    rows = similarity.pair_measures(frame(spark, {"1": ["A", "B;C"], "2": ["A", "B;D"]})).collect()
    assert [(r.ai, r.contained) for r in rows] == [(1 / 3, False)]


def test_edges_random(spark):
    rng = random.Random(3)
    baskets = {f"b{k}": [rng.choice(["A", "B", "C;D", "E", "-", "F;A"]) for _ in range(rng.randint(0, 5))] for k in range(40)}
    rows = similarity.similarity_edges(frame(spark, baskets), 0.5).collect()
    assert {(r.bgc1, r.bgc2): (r.ai, r.contained) for r in rows} == brute(baskets)
    alone = similarity.unlinked(frame(spark, baskets), similarity.similarity_edges(frame(spark, baskets), 0.5)).collect()
    assert {r.bgc_id for r in alone} == set(baskets) - {x for e in brute(baskets) for x in e}


def test_choose():
    assert similarity.choose([["1", "2"], ["3"]], {"1": 1, "2": 2, "3": 3}, {"1": 1, "2": 1, "3": 0}) == {"2": {"1", "2"}, "3": {"3"}}


def naive_cliques(edges):
    nodes = sorted({x for e in edges for x in e})
    linked = {frozenset(e) for e in edges}
    every = [set(c) for n in range(1, len(nodes) + 1) for c in combinations(nodes, n) if all(frozenset(p) in linked for p in combinations(c, 2))]
    return {frozenset(c) for c in every if not any(c < d for d in every)}


def test_cliques_random():
    rng = random.Random(5)
    for _ in range(60):
        nodes = range(rng.randint(2, 8))
        edges = [e for e in combinations(nodes, 2) if rng.random() < 0.5]
        assert {frozenset(c) for c in maximal_cliques(edges)} == naive_cliques(edges)


def test_representatives(spark):
    baskets = {"a": ["A", "B", "C"], "b": ["A", "B"], "c": ["A"], "d": ["X", "Y"], "e": ["-"], "f": ["Q"]}
    del baskets["e"]
    reps, members = similarity.filter_similar(frame(spark, baskets), 0.95)
    found = {}
    for r in members.collect():
        found.setdefault(r.rep, set()).add(r.member)
    assert found == {"a": {"a", "b", "c"}, "d": {"d"}, "f": {"f"}}
    assert {r.bgc_id for r in reps.collect()} == {"a", "d", "f"}


def test_components(spark):
    rng = random.Random(8)
    edges = [(f"n{a:02d}", f"n{b:02d}") for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(45))]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = similarity.connected(spark.createDataFrame(edges, "bgc1 string, bgc2 string")).collect()
    assert {r.bgc_id: r.component for r in rows} == {x: root(x) for x in parent}


def test_index_is_counted_once(spark):
    """What meets at an element is dealt by the count that ranked it; sets are read for index and counts only."""
    from basketloom.operators import similarity

    sets = spark.createDataFrame([("a", ["x"]), ("b", ["x", "y"]), ("c", ["y", "z"])], "class_id string, domains array<string>")
    found = similarity.contained_candidates(sets)
    assert [tuple(r) for r in found.collect()] == [("a", "b")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4


def test_baskets_are_worked_out_once(spark):
    """Sets and members come from one evaluation; pairs that no other set holds are in no index."""
    from basketloom.operators import similarity

    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    baskets = frame(spark, {"a": ["A", "B", "C"], "b": ["A", "B"], "c": ["Q"], "d": ["A", "B"], "e": ["-"]})
    found = similarity.links(baskets.mapInPandas(count, baskets.schema), 0.3)
    assert sorted((r.bgc1, r.bgc2) for r in found.pairs().collect() if "e" not in (r.bgc1, r.bgc2)) == [("a", "b"), ("a", "d"), ("b", "d")]
    assert {r.class_id: r["size"] for r in found.classes.collect()} == {"a": 1, "b": 2, "c": 1, "e": 1}
    assert seen.value == 5
    sets = spark.createDataFrame([("a", ["p", "q", "r"]), ("b", ["r", "s"]), ("c", ["t"])], "class_id string, pairs array<string>")
    assert sorted((r.class_id, r.n, r.held, r.place) for r in similarity._shared(sets, "pairs").collect()) == [("a", 3, 2, 2), ("b", 2, 2, 1)]


def test_containment_alone_works_out_no_pairs(spark):
    """Without a cut-off, baskets of the same domains are one class in whatever order, and the index is null."""
    baskets = {"a": ["A", "B", "C"], "b": ["B", "A", "C"], "c": ["A;B"], "d": ["C", "X"], "e": ["-"], "f": ["Q"]}
    found = similarity.links(frame(spark, baskets), None)
    assert {r.class_id: r["size"] for r in found.classes.collect()} == {"a": 2, "c": 1, "d": 1, "e": 1, "f": 1}
    wanted = {pair for pair, (_, contained) in brute(baskets).items() if contained}
    assert {(r.bgc1, r.bgc2, r.ai, r.contained) for r in found.pairs().collect()} == {(*pair, None, True) for pair in wanted}


def test_steps_leave_little_on_disk(spark):
    """What links() leaves are three tables, compressed, of classes, members and edges; no step keeps its shuffle files."""
    import time
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "basketloom-files"
    tables = lambda: set(shared.glob("*/table"))
    shuffles = lambda: {str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before, kept = tables(), shuffles()
    links = similarity.links(frame(spark, {f"b{k}": [f"{k}", f"{k + 1}", "x"] for k in range(50)} | {"s": ["1", "x"]}), 0.5)
    new = tables() - before
    assert len(new) == 3 and all(list(t.glob("*.zstd.parquet")) for t in new)
    end = time.time() + 20
    while shuffles() - kept and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - kept
    assert {(r.bgc1, r.bgc2) for r in links.pairs().collect()} >= {("b0", "s"), ("b1", "s")}
