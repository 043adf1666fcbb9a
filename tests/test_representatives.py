"""Representatives by classes and spread over tasks, against the rounds on the whole graph of baskets."""

import random
from itertools import combinations

import pytest

from basketloom.operators import representatives, similarity
from basketloom.operators.representatives import of_classes
from basketloom.operators.similarity import representatives_of

from .test_large_graphs import copies
from .test_similarity import brute, frame


def random_graph(rng, prefix, most=9):
    """(class edges, nodes by class, members by class, basket edges, domains by basket)."""
    n, share = rng.randint(2, most), rng.choice([0.2, 0.4, 0.6])
    edges = [(a, b) for a, b in combinations(range(n), 2) if rng.random() < share]
    ids = [f"{prefix}b{k:02d}" for k in range(4 * n)]
    rng.shuffle(ids)
    members = {k: [ids.pop() for _ in range(rng.choice([1, 1, 2, 3]))] for k in range(n)}
    size = {b: rng.randint(1, 3) for m in members.values() for b in m}
    met = {x for e in edges for x in e}
    every = {tuple(sorted((x, y))) for a, b in edges for x in members[a] for y in members[b]} | {tuple(sorted(p)) for k in met for p in combinations(members[k], 2)}
    label = {k: min(m) for k, m in members.items()}
    nodes = {label[k]: (min(m, key=lambda b: (-size[b], b)), max(size[b] for b in m), len(m)) for k, m in members.items() if k in met}
    return sorted(tuple(sorted((label[a], label[b]))) for a, b in edges), nodes, {label[k]: m for k, m in members.items()}, sorted(every), size


def expanded(found, members):
    return {(rep, x) for rep, stands in found.items() for m in stands for x in (members[m[0]] if isinstance(m, tuple) else [m])}


def pairs(found):
    return {(rep, m) for rep, stands in found.items() for m in stands}


def test_classes_are_nodes():
    rng = random.Random(1)
    for _ in range(500):
        edges, nodes, members, every, size = random_graph(rng, "")
        assert expanded(of_classes(edges, nodes), members) == pairs(representatives_of(every, size))


@pytest.mark.parametrize("local", [0, 40])
def test_spread_over_tasks(spark, monkeypatch, local):
    """All cliques that are ready at once, or stretches of the order by one task: the same rounds."""
    monkeypatch.setattr(representatives, "LOCAL", local)
    rng = random.Random(3 + local)
    edges, nodes, members, wanted = [], {}, {}, set()
    for k in range(60):
        e, n, m, every, size = random_graph(rng, f"g{k:02d}", 10 if k else 14)
        edges += e
        nodes |= n
        members |= m
        wanted |= pairs(representatives_of(every, size))
    rows = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node string, rep string, n long, weight long")
    got = representatives.distributed(rows, spark.createDataFrame(edges + edges[:5], "u string, v string")).collect()
    assert {(r.rep, x) for r in got for x in (members[r.class_id] if r.member is None else [r.member])} == wanted


def test_cliques_spread_over_tasks(spark):
    rng = random.Random(6)
    edges = [(f"n{a:02d}", f"n{b:02d}") for a, b in combinations(range(25), 2) if rng.random() < 0.4] + [("hub", f"x{k:03d}") for k in range(300)]
    got = sorted(tuple(r.members) for r in representatives.clique_members(spark.createDataFrame(edges, "u string, v string")).collect())
    assert got == sorted(tuple(sorted(c)) for c in representatives.maximal_cliques(edges))


def test_a_long_chain(spark, monkeypatch):
    """Each clique waits for the one before: stretches keep the number of rounds down, and no group exceeds the bound."""
    monkeypatch.setattr(representatives, "LOCAL", 500)
    held = []
    real = representatives._in_order
    monkeypatch.setattr(representatives, "_in_order", lambda part: held.append(len(part)) or real(part))
    n = 700
    edges, nodes = [(f"n{k:04d}", f"n{k + 1:04d}") for k in range(n)], {f"n{k:04d}": (f"n{k:04d}", k * 7919 % 11, 1) for k in range(n + 1)}
    rows = spark.createDataFrame([(k, *v) for k, v in nodes.items()], "node string, rep string, n long, weight long")
    got = representatives.distributed(rows, spark.createDataFrame(edges, "u string, v string")).collect()
    assert {(r.rep, r.member) for r in got} == pairs(of_classes(edges, nodes))


def test_baskets_with_copies(spark):
    baskets = copies(5, 70)
    links = similarity.links(frame(spark, baskets), 0.5)
    got = {(r.rep, r.member) for r in similarity.representatives(frame(spark, baskets), links).collect()}
    linked = brute(baskets)
    sizes = {k: sum(len(g.split(";")) for g in genes if g != "-") for k, genes in baskets.items()}
    assert got == pairs(representatives_of(sorted(linked), sizes)) | {(k, k) for k in set(baskets) - {x for e in linked for x in e}}
    none = frame(spark, baskets).limit(0)
    assert similarity.representatives(none, similarity.links(none, 0.5)).count() == 0
