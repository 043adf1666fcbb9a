"""Maximal cliques of small graphs (Bron-Kerbosch with pivots, iterative)."""

from __future__ import annotations

from collections.abc import Hashable, Iterable, Iterator


def neighbours(edges: Iterable[tuple[Hashable, Hashable]]) -> dict[Hashable, set]:
    out: dict[Hashable, set] = {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            out.setdefault(b, set()).add(a)
    return out


def maximal_cliques(edges: Iterable[tuple[Hashable, Hashable]], nodes: Iterable[Hashable] = ()) -> Iterator[set]:
    """All maximal cliques; ``nodes`` may add nodes without an edge."""
    near = neighbours(edges)
    for v in nodes:
        near.setdefault(v, set())
    if not near:
        return
    # Each frame holds a clique, its candidates, the nodes already done, and those candidates still to be tried.
    stack = [(frozenset(), set(near), set(), None)]
    while stack:
        clique, candidates, done, todo = stack.pop()
        if todo is None:
            if not candidates:
                if not done:
                    yield set(clique)
                continue
            pivot = max(candidates | done, key=lambda v: len(near[v] & candidates))
            todo = candidates - near[pivot]
        if not todo:
            continue
        v = todo.pop()
        inner = (clique | {v}, candidates & near[v], done & near[v], None)
        stack.append((clique, candidates - {v}, done | {v}, todo))
        stack.append(inner)
