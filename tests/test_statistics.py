"""Interaction counts, p-values, correction, modules and detection against brute force."""

import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import pytest

from basketloom.operators import interactions, modules, pvalues
from basketloom.operators.pvalues import binomial, tail

from .test_similarity import frame, naive_cliques


def baskets_of(seed, n=30, genes="ABCDE-"):
    rng = random.Random(seed)
    return {f"b{k}": [rng.choice(genes) for _ in range(rng.randint(1, 7))] for k in range(n)}


def naive_adjacency(baskets):
    cnt, n1, n2, b1, b2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for g in baskets.values():
        if len(g) == 1:
            continue
        for i, x in enumerate(g):
            near = [g[j] for j in (i - 1, i + 1) if 0 <= j < len(g)]
            if x != "-":
                cnt[x] += 1
                n1[x] += len(near)
                for y in near:
                    if y not in ("-", x):
                        b1[x, y] += 1
            if len(near) == 2 and near[0] == near[1] != "-":
                p = near[0]
                n1[p] -= 2
                n2[p] += 1
                if x not in ("-", p):
                    b1[p, x] -= 2
                    b2[p, x] += 1
    return cnt, n1, n2, b1, b2


def test_adjacency(spark):
    for seed in (1, 2):
        baskets = baskets_of(seed)
        cnt, n1, n2, b1, b2 = naive_adjacency(baskets)
        rows = frame(spark, baskets)
        assert {r.gene: (r.cnt, r.n1, r.n2) for r in interactions.adjacency_nodes(rows).collect()} == {x: (cnt[x], n1[x], n2[x]) for x in cnt}
        wanted = {p: (b1[p], b2[p]) for p in {*b1, *b2} if b1[p] or b2[p]}
        assert {(r.a, r.b): (r.b1, r.b2) for r in interactions.adjacency_pairs(rows).collect()} == wanted


def naive_colocation(baskets):
    cnt, n1, b1, total = Counter(), Counter(), Counter(), 0
    for g in baskets.values():
        real = Counter(x for x in g if x != "-")
        size = len(g) + 2 * sum(c > 1 for c in real.values())
        total += size
        for x in real:
            cnt[x] += 1
            n1[x] += size - 1
            for y in real:
                if x != y:
                    b1[x, y] += 1
    return cnt, n1, b1, total


def test_colocation(spark):
    baskets = baskets_of(3)
    cnt, n1, b1, total = naive_colocation(baskets)
    rows = frame(spark, baskets)
    assert {r.gene: (r.cnt, r.n1) for r in interactions.colocation_nodes(rows).collect()} == {x: (cnt[x], n1[x]) for x in cnt}
    assert {(r.a, r.b): r.b1 for r in interactions.colocation_pairs(rows).collect()} == dict(b1)
    assert interactions.colocation_total(rows).first().n == total


def exact(n0, n1, n2, b1, b2, bt, nt):
    whole = Fraction(binomial(nt, bt))
    if b2 == 0 or b1 == 0:
        near, seen = (n1, b1) if b2 == 0 else (n2, b2)
        return float(1 - sum(binomial(n0, bt - d) * binomial(near, d) for d in range(seen)) / whole)
    return float(1 - sum(binomial(n0, bt - x - y) * binomial(n1, x) * binomial(n2, y) for x in range(b1 + 1) for y in range(b2 + 1) if (x, y) != (b1, b2)) / whole)


def test_tails(monkeypatch):
    assert binomial(-3, 2) == 6 and binomial(4, -1) == 0 and binomial(3, 5) == 0
    cases = [(500, 40, 0, 9, 0, 30, 540), (500, 40, 6, 9, 2, 30, 546), (500, 40, 6, 0, 2, 30, 546), (90, 5, 3, 1, 1, 10, 98), (400, 300, 0, 3, 0, 6, 700), (-1, 3, 0, 1, 0, 1, 2)]
    for c in cases:
        assert abs(tail(*c) - exact(*c)) <= 1e-12 * max(1, exact(*c)), c
    tail.cache_clear()
    monkeypatch.setattr(pvalues, "EXACT", 0)
    for c in cases[:-1]:
        assert abs(tail(*c) - exact(*c)) <= 1e-9 * max(exact(*c), 1e-3), c
    tail.cache_clear()


def test_small_tails_keep_their_size():
    assert 0 < tail(10_000, 40, 0, 30, 0, 30, 10_040) < 1e-30


def naive_by(p):
    order = sorted(p, key=lambda k: (p[k], k))
    n, c = len(p), sum(1 / i for i in range(1, len(p) + 1))
    out, least = {}, 1.0
    for rank, k in reversed(list(enumerate(order, 1))):
        least = min(least, p[k] * n * c / rank)
        out[k] = least
    return out


def test_edges(spark):
    baskets = baskets_of(4, 60)
    rows = frame(spark, baskets)
    cnt, n1, b1, total = naive_colocation(baskets)
    co = {(a, b): exact(total - cnt[a] - n1[a], n1[a], 0, x, 0, cnt[b], total - cnt[a]) for (a, b), x in b1.items()}
    got = {(r.a, r.b): r.pval for r in pvalues.colocation_pvalues(rows).collect()}
    assert got.keys() == co.keys() and all(abs(got[k] - co[k]) < 1e-9 for k in co)
    cnt, n1, n2, b1, b2 = naive_adjacency(baskets)
    total = sum(map(len, baskets.values()))
    ad = {k: exact(total - cnt[k[0]] - n1[k[0]] - n2[k[0]], n1[k[0]], n2[k[0]], b1[k], b2[k], cnt[k[1]], total - cnt[k[0]]) for k in {*b1, *b2} if b1[k] or b2[k]}
    got = {(r.a, r.b): r.pval for r in pvalues.adjacency_pvalues(rows).collect()}
    assert got.keys() == ad.keys() and all(abs(got[k] - ad[k]) < 1e-9 for k in ad)
    wanted = {}
    for p in (naive_by(co), naive_by(ad)):
        for (a, b), v in p.items():
            if a < b and (b, a) in p:
                wanted[a, b] = min(wanted.get((a, b), 2), max(v, p[b, a]))
    got = {(r.g1, r.g2): r.pval for r in pvalues.interaction_edges(rows).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-9 for k in wanted)


def test_no_edges(spark):
    rows = frame(spark, {"a": ["-"], "b": ["A"]})
    assert pvalues.interaction_edges(rows).count() == 0
    assert modules.build_modules(rows, 0.1).count() == 0


def sweep(edges):
    """Maximal cliques of three or more at every cut-off, with the smallest cut-off of each."""
    out = {}
    for cut in sorted(set(edges.values())):
        for c in naive_cliques([e for e, p in edges.items() if p <= cut]):
            if len(c) > 2:
                out.setdefault(tuple(sorted(c)), cut)
    return out


def test_modules(spark, monkeypatch):
    rng = random.Random(6)
    for broadcast in (10**6, -1):
        monkeypatch.setattr(modules, "BROADCAST_EDGES", broadcast)
        edges = {e: rng.choice([0.1, 0.2, 0.3, 0.4]) for e in combinations("ABCDEFG", 2) if rng.random() < 0.7}
        rows = spark.createDataFrame([(a, b, p) for (a, b), p in edges.items()], "g1 string, g2 string, pval double")
        got = {tuple(r.genes): r.strictest_pval for r in modules.find_modules(rows).collect()}
        assert got == sweep(edges)


def test_detection(spark):
    baskets = frame(spark, {"x": ["A", "B", "C", "A"], "y": ["A", "B"], "z": ["C", "B", "A", "D"]})
    known = spark.createDataFrame([(["A", "B", "C"], 0.1), (["B", "C", "D"], 0.2), (["D", "E", "F"], 0.3)], "genes array<string>, strictest_pval double")
    counted = modules.occurrences(baskets, known)
    assert {tuple(r.genes): r.occurences for r in counted.collect()} == {("A", "B", "C"): 2, ("B", "C", "D"): 1, ("D", "E", "F"): 0}
    kept = modules.filter_infrequent(counted).collect()
    assert [(r.module_id, r.genes) for r in kept] == [(1, ["A", "B", "C"])]
    ids = modules.with_ids(known)
    found = modules.detect(baskets, ids)
    assert {(r.bgc_id, r.module_id) for r in found.collect()} == {("x", 1), ("z", 1), ("z", 2)}
    assert {r.bgc_id: r.module_ids for r in modules.detected_ids(baskets, found).collect()} == {"x": "1", "y": "", "z": "1,2"}
    assert {r.bgc_id: r.value for r in modules.detected_blocks(baskets, found).collect()} == {"x": ">x\n1\tA,B,C", "y": ">y", "z": ">z\n1\tA,B,C\n2\tB,C,D"}


@pytest.mark.parametrize("total", [10**6, 10**8, 10**9, 10**10])
def test_tails_of_many_places(total, monkeypatch):
    """Sums of positive terms against exact rationals: never below 0, right to nine digits."""
    import random
    from fractions import Fraction

    rng = random.Random(total)
    for _ in range(50):
        n1, n2, total_b = rng.choice([0, 1, 40, 2000, 30_000]), rng.choice([0, 1, 5, 300]), rng.choice([1, 9, 30, 500, 1500])
        b1 = rng.randint(0, min(n1, total_b, 4))
        b2, n0, whole = rng.randint(0, min(n2, total_b - b1, 3)), total - n1 - n2, pvalues.binomial(total, total_b)
        if b1 == 0 or b2 == 0:
            near, seen = (n1, b1) if b2 == 0 else (n2, b2)
            less = sum(pvalues.binomial(n0, total_b - d) * pvalues.binomial(near, d) for d in range(seen))
        else:
            less = sum(pvalues.binomial(n0, total_b - x - y) * pvalues.binomial(n1, x) * pvalues.binomial(n2, y) for x in range(b1 + 1) for y in range(b2 + 1) if (x, y) != (b1, b2))
        wanted, got = float(Fraction(whole - less, whole)), pvalues.tail(n0, n1, n2, b1, b2, total_b, total)
        assert got >= 0 and abs(got - wanted) <= 1e-9 * wanted
