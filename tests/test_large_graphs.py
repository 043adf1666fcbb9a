"""Similarity by classes, modules by triangles, and tails with large counts: against plain versions."""

import random
import time
from decimal import Decimal, getcontext
from itertools import combinations

import numpy as np
import pytest

from basketloom.operators import modules, pvalues, similarity

from .test_similarity import brute, frame


def copies(seed, n=90):
    """Baskets of which many are copies, some empty, some within others."""
    rng = random.Random(seed)
    kinds = [[rng.choice(["A", "B", "C;D", "E", "-", "F;A", "G", "H"]) for _ in range(rng.randint(0, 6))] for _ in range(n // 4)] + [["-"], []]
    return {f"b{k:03d}": rng.choice(kinds) for k in range(n)}


@pytest.mark.parametrize("seed, per_salt", [(1, 50_000), (2, 3)])
def test_links_of_copies(spark, monkeypatch, seed, per_salt):
    """Pairs, unlinked baskets and components, however many tasks an element is dealt to."""
    monkeypatch.setattr(similarity, "PER_SALT", per_salt)
    baskets = copies(seed)
    links = similarity.links(frame(spark, baskets), 0.5)
    assert links.classes.count() < len(baskets)
    wanted = brute(baskets)
    assert {(r.bgc1, r.bgc2): (r.ai, r.contained) for r in links.pairs().collect()} == wanted
    parent = {x: x for e in wanted for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in wanted:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {r.bgc_id: r.component for r in links.components().collect()} == {x: root(x) for x in parent}
    assert {r.bgc_id for r in links.unlinked().collect()} == set(baskets) - set(parent)


def test_links_by_one_measure(spark):
    baskets = copies(4, 60)
    every = {k: v for k, v in brute(baskets).items()}
    held = {k for k, (_, contained) in every.items() if contained}
    assert {(r.bgc1, r.bgc2) for r in similarity.links(frame(spark, baskets), None).pairs().collect()} == held
    near = {(r.bgc1, r.bgc2): r.ai for r in similarity.links(frame(spark, baskets), 0.5, contained=False).pairs().collect()}
    assert near == {k: ai for k, (ai, _) in every.items() if ai > 0.5}
    none = similarity.links(frame(spark, {"x": ["A"]}).limit(0), 0.5)
    assert (none.pairs().count(), none.unlinked().count(), none.components().count()) == (0, 0, 0)


def test_pairs_below_the_bounds_do_not_meet(spark):
    """Sets that share only what is common to all are no candidates at a high cut-off."""
    baskets = {f"b{k}": ["common"] + [f"{k}_{j}" for j in range(10)] for k in range(200)} | {"s": ["0_1", "0_2"], "t": [f"0_{j}" for j in range(10)]}
    sets = similarity.features(frame(spark, baskets)).withColumnRenamed("bgc_id", "class_id")
    assert {tuple(r) for r in similarity.contained_candidates(sets).collect()} == {("b0", "s"), ("b0", "t"), ("s", "t")}
    assert {tuple(r) for r in similarity.adjacent_candidates(sets, 0.8).collect()} == {("b0", "t")}


def edges_of(rng, n, share, values=6):
    return [(f"n{a:02d}", f"n{b:02d}", rng.randint(1, values) / 10) for a, b in combinations(range(n), 2) if rng.random() < share]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_modules_by_triangles(spark, seed):
    """The same modules as with the whole graph in hand, with ties among p-values."""
    rng = random.Random(seed)
    edges = spark.createDataFrame(edges_of(rng, 14, 0.6), "g1 string, g2 string, pval double")
    flipped = edges.selectExpr("g2 AS g1", "g1 AS g2", "pval + 1 AS pval").union(edges.selectExpr("g1", "g1", "0.0D"))
    wanted = {(tuple(r.genes), r.strictest_pval) for r in modules.find_modules(edges).collect()}
    got = {(tuple(r.genes), r.strictest_pval) for r in modules._by_triangles(edges).distinct().collect()}
    assert got == wanted and any(len(g) > 3 for g, _ in got)
    assert {(tuple(r.genes), r.strictest_pval) for r in modules.find_modules(edges.union(flipped)).collect()} == wanted


def test_a_hub_is_no_group(spark):
    """A star with a clique in it: the hub's neighbourhood is never gathered."""
    star = [("hub", f"leaf{k:04d}", 0.01) for k in range(3000)]
    clique = [(a, b, 0.02) for a, b in combinations(["hub", "leaf0001", "leaf0002", "leaf0003", "leaf0004"], 2) if a != "hub"]
    edges = spark.createDataFrame(star + clique, "g1 string, g2 string, pval double")
    out = modules.directed(edges)
    assert max(r["count"] for r in out.groupBy("u").count().collect()) <= 4
    third = modules.common_neighbours(edges, out)
    assert max(r["count"] for r in third.groupBy("g1", "g2").count().collect()) <= 3
    assert [(r.genes, r.strictest_pval) for r in modules._by_triangles(edges).distinct().collect()] == [(["hub", "leaf0001", "leaf0002", "leaf0003", "leaf0004"], 0.02)]
    assert modules._by_triangles(edges.limit(0)).count() == 0


def high_precision(n0, n1, n2, b1, b2, draws, total):
    """The tail as one minus the sum of all that has no more of either, from ratios in 80 digits."""
    getcontext().prec = 80
    first = Decimal(1)
    for i in range(min(total - n0, draws)):
        first = first * ((total - draws - i) if total - n0 < draws else (n0 - i)) / (total - i)
    if b1 == 0 or b2 == 0:
        near, seen = (n1, b1) if b2 == 0 else (n2, b2)
        b1, b2, n1, n2 = seen - 1, 0, near, 0
        last = None
    else:
        last = (b1, b2)
    less, row = Decimal(0), first
    for x in range(b1 + 1):
        term = row
        for y in range(b2 + 1):
            if (x, y) != last:
                less += term
            term = term * (n2 - y) * (draws - x - y) / ((y + 1) * (n0 - draws + x + y + 1))
        row = row * (n1 - x) * (draws - x) / ((x + 1) * (n0 - draws + x + 1))
    return 1 - less


CASES = [
    (10**6, 20_000, 3000, 60, 9, 1500), (10**6, 20_000, 3000, 15, 0, 1500), (10**6, 50_000, 2000, 0, 12, 4000), (10**8, 10**6, 10**5, 200, 20, 12_000), (10**8, 10**6, 10**5, 90, 20, 12_000),
    (10**10, 3 * 10**7, 4 * 10**6, 700, 60, 200_000), (10**10, 3 * 10**7, 4 * 10**6, 500, 80, 200_000), (10**10, 10**8, 0, 900, 0, 60_000), (45_000, 3000, 300, 100, 10, 900), (1000, 700, 50, 60, 3, 70),
]


@pytest.mark.parametrize("total, n1, n2, b1, b2, draws", CASES)
def test_tails_with_large_counts(total, n1, n2, b1, b2, draws):
    wanted = high_precision(total - n1 - n2, n1, n2, b1, b2, draws, total)
    got = pvalues.tails(*([v] for v in (total - n1 - n2, n1, n2, b1, b2, draws, total)))[0]
    assert wanted > 0 and abs(Decimal(float(got)) - wanted) <= Decimal("1e-9") * wanted


def test_many_tails_at_once():
    """A batch of tails with thousands seen among 1e10 places takes well under 10 ms for each, and is that of single ones."""
    rng = np.random.default_rng(1)
    b1, b2 = rng.integers(1000, 3000, 200), rng.integers(0, 500, 200)
    n1, n2, draws, total = np.full(200, 3 * 10**7), np.full(200, 4 * 10**6), rng.integers(300_000, 900_000, 200), np.full(200, 10**10)
    began = time.process_time()
    got = pvalues.tails(total - n1 - n2, n1, n2, b1, b2, draws, total)
    assert (time.process_time() - began) / 200 < 0.01 and ((got >= 0) & (got <= 1)).all()
    for k in (0, 7, 50):
        assert abs(got[k] - pvalues.tail(*(int(v[k]) for v in (total - n1 - n2, n1, n2, b1, b2, draws, total)))) <= 1e-12 * got[k]


def test_tails_without_places():
    """More hits than places, none at all, and more neighbours than places."""
    assert pvalues.tail(5, 3, 0, 1, 0, 20, 8) == 1.0 and pvalues.tail(0, 0, 0, 1, 0, 0, 0) == 0.0
    assert pvalues.tail(-(10**6), 3 * 10**6, 0, 5, 0, 50, 2 * 10**6) == 1.0
    assert pvalues.tails(*([] for _ in range(7))).tolist() == []
