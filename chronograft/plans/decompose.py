"""Root choice, spanning trees and equivalence classes of patterns; all of it small driver work.

Trees decide the order and the reports of candidate relations, never the result of a match.
"""

from __future__ import annotations

import heapq
import math
from collections import deque
from dataclasses import dataclass, field

from chronograft.plans.pattern import Pattern

TIE = 1e-15


@dataclass
class Decomposition:
    root: int
    order: list[int]
    parent: dict[int, int | None]
    children: dict[int, list[int]]
    non_tree: list[tuple[int, int]]
    scores: dict[int, float]
    connected: bool = True
    levels: dict[int, int] = field(default_factory=dict)
    removed: list[tuple[int, int]] = field(default_factory=list)


def score_temporal(p: Pattern, counts: dict[str, int], lifespans: dict[str, float]) -> dict[int, float]:
    """degree / (label count * average lifespan); infinite where a factor is zero. The least wins."""
    out = {}
    for q, label in enumerate(p.labels):
        size = counts.get(label, 0) * lifespans.get(label, 0.0)
        out[q] = (len(p.out(q)) + len(p.inc(q))) / size if size > 0 else math.inf
    return out


def score_topological(p: Pattern, counts: dict[str, int]) -> dict[int, float]:
    """label count / degree; the least wins."""
    degree = lambda q: len(p.out(q)) + len(p.inc(q))
    return {q: counts.get(label, 0) / degree(q) if degree(q) else math.inf for q, label in enumerate(p.labels)}


def score_inverse(p: Pattern, counts: dict[str, int], lifespans: dict[str, float]) -> dict[int, float]:
    """label count * lifespan / out-degree, of the breadth-first variant."""
    return {q: counts.get(x, 0) * lifespans.get(x, 0.0) / len(p.out(q)) if p.out(q) else math.inf for q, x in enumerate(p.labels)}


def choose_root(p: Pattern, scores: dict[int, float], counts: dict[str, int]) -> int:
    """Least score; ties within TIE go to fewer candidates, then to the lower vertex."""
    finite = [q for q in range(p.n) if math.isfinite(scores[q])]
    if not finite:
        return next((q for q in range(p.n) if p.neighbours(q) or (q, q) in p.arcs), 0)
    best = finite[0]
    for q in finite[1:]:
        gap = scores[q] - scores[best]
        if gap < -TIE or abs(gap) <= TIE and counts.get(p.labels[q], 0) < counts.get(p.labels[best], 0):
            best = q
    return best


def choose_label(pairs: list[tuple[str, str]], counts: dict[str, int], lifespans: dict[str, float] | None = None) -> str:
    """Root of a pattern given as pairs of labels, each label being one vertex of either-way neighbours.

    With lifespans the least degree / (count * lifespan), else the least count / degree; labels of
    no vertices or no lifespan are out. Ties go to fewer vertices, then to the lower label.
    """
    near: dict[str, set[str]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    usable = [x for x in near if counts.get(x, 0) > 0 and (lifespans is None or lifespans.get(x, 0.0) > 0)]
    if not usable:
        raise ValueError("no label of the pattern has vertices")
    score = {x: counts[x] / len(near[x]) if lifespans is None else len(near[x]) / (counts[x] * lifespans[x]) for x in usable}
    least = min(score.values())
    return min((x for x in usable if score[x] - least < 1e-12), key=lambda x: (counts[x], x))


def _finish(p: Pattern, root: int, order: list[int], parent: dict, scores: dict, **more) -> Decomposition:
    tree = {frozenset((a, b)) for a, b in parent.items() if b is not None}
    children = {q: [c for c in order if parent.get(c) == q] for q in range(p.n)}
    non_tree = [(a, b) for a, b in p.arcs if frozenset((a, b)) not in tree]
    return Decomposition(root, order, parent, children, non_tree, scores, len(order) == p.n, **more)


def depth_first(p: Pattern, scores: dict[int, float], counts: dict[str, int]) -> Decomposition:
    """Tree of a depth-first walk over neighbours in either direction by (score, vertex)."""
    root = choose_root(p, scores, counts)
    parent: dict[int, int | None] = {root: None}
    order: list[int] = []

    def walk(q: int) -> None:
        order.append(q)
        for c in sorted(p.neighbours(q), key=lambda c: (scores[c], c)):
            if c not in parent:
                parent[c] = q
                walk(c)

    walk(root)
    return _finish(p, root, order, parent, scores)


def by_temporal(p: Pattern, counts: dict[str, int], lifespans: dict[str, float]) -> Decomposition:
    return depth_first(p, score_temporal(p, counts, lifespans), counts)


def by_topology(p: Pattern, counts: dict[str, int]) -> Decomposition:
    return depth_first(p, score_topological(p, counts), counts)


def breadth_first(p: Pattern, counts: dict[str, int], lifespans: dict[str, float]) -> Decomposition:
    """Breadth-first tree with levels, rooted at the least inverse score."""
    scores = score_inverse(p, counts, lifespans)
    root = min(range(p.n), key=lambda q: (scores[q], q))
    parent: dict[int, int | None] = {root: None}
    levels, todo, order = {root: 0}, deque([root]), []
    while todo:
        q = todo.popleft()
        order.append(q)
        for c in p.neighbours(q):
            if c not in parent:
                parent[c], levels[c] = q, levels[q] + 1
                todo.append(c)
    return _finish(p, root, order, parent, scores, levels=levels)


def minimum_spanning(p: Pattern, counts: dict[str, int], durations: dict[str, float]) -> Decomposition:
    """Spanning tree of least arc weight (mean duration of its labels), oriented from the topological root."""
    scores = score_topological(p, counts)
    root = choose_root(p, scores, counts)
    group = list(range(p.n))

    def find(a: int) -> int:
        while group[a] != a:
            group[a] = group[group[a]]
            a = group[a]
        return a

    pairs = sorted({tuple(sorted(x)) for x in p.arcs if x[0] != x[1]}, key=lambda x: ((durations.get(p.labels[x[0]], 0.0) + durations.get(p.labels[x[1]], 0.0)) / 2, x))
    tree, removed = [], []
    for a, b in pairs:
        ra, rb = find(a), find(b)
        (removed if ra == rb else tree).append((a, b))
        group[max(ra, rb)] = min(ra, rb)
    near = {q: sorted([b for a, b in tree if a == q] + [a for a, b in tree if b == q]) for q in range(p.n)}
    parent: dict[int, int | None] = {root: None}
    order, todo = [], deque([root])
    while todo:
        q = todo.popleft()
        order.append(q)
        for c in near[q]:
            if c not in parent:
                parent[c] = q
                todo.append(c)
    return _finish(p, root, order, parent, scores, removed=removed)


def start_vertices(p: Pattern, counts: dict[str, int], most: int = 3) -> list[int]:
    """Up to ``most`` vertices of least label count / undirected degree."""
    rank = lambda q: (counts.get(p.labels[q], 0) / max(1, len(p.neighbours(q))), q)
    return heapq.nsmallest(most, range(p.n), key=rank)


def equivalence_classes(p: Pattern) -> list[list[int]]:
    """Vertices of one label whose neighbours, leaving each other out, are the same in either direction."""

    def same(a: int, b: int) -> bool:
        if p.labels[a] != p.labels[b] or ((a, b) in p.arcs) != ((b, a) in p.arcs):
            return False
        drop = {a, b}
        loops = ((a, a) in p.arcs) == ((b, b) in p.arcs)
        return loops and set(p.out(a)) - drop == set(p.out(b)) - drop and set(p.inc(a)) - drop == set(p.inc(b)) - drop

    out: list[list[int]] = []
    for q in range(p.n):
        for c in out:
            if all(same(q, x) for x in c):
                c.append(q)
                break
        else:
            out.append([q])
    return out


def matching_order(d: Decomposition, sizes: dict[int, int]) -> list[int]:
    """Leaves by candidates over (non-tree arcs + 1), each path followed from the root."""
    closing = lambda q: sum(q in a for a in d.non_tree)
    leaves = sorted((q for q in d.order if not d.children[q]), key=lambda q: (sizes.get(q, 0) / (closing(q) + 1), q))
    out: list[int] = []
    for leaf in leaves:
        path, q = [], leaf
        while q is not None:
            path.append(q)
            q = d.parent[q]
        out += [x for x in reversed(path) if x not in out]
    return out


def combinations(n: int, m: int) -> float:
    return float(math.comb(n, m)) if 0 <= m <= n else 0.0
