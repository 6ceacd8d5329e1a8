"""Candidate relations of a pattern's tree: selection, expansion, and trims by semi-joins.

The relation of a tree vertex has one row (v_par, v_cand) for each candidate under a candidate of
its parent. Bottom-up and top-down trims are the two passes of a semi-join reduction; what is left
bounds every match, so it serves both as a report and to reduce the matcher's legs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.operators import stats
from chronograft.operators.graph import TemporalGraph
from chronograft.plans.decompose import Decomposition
from chronograft.plans.pattern import LABELS, Pattern
from chronograft.storage import keep


def vertex_candidates(profiles: DataFrame, p: Pattern, q: int, k: int) -> DataFrame:
    """Vertices (v) whose label, degrees, neighbour labels and duration allow pattern vertex ``q``."""
    out, inc = p.out(q), p.inc(q)
    test = (F.col("label") == p.labels[q]) & (F.col("out_deg") >= len(out)) & (F.col("in_deg") >= len(inc)) & (F.col("active_duration") >= k)
    for x in LABELS:
        for side, near in (("out", out), ("in", inc)):
            n = sum(p.labels[b] == x for b in near)
            if n:
                test &= F.col(f"{side}_{x}") >= n
    return profiles.where(test).select(F.col("id").alias("v"))


def reject_reasons(profiles: DataFrame, p: Pattern, q: int, k: int) -> DataFrame:
    """One row: vertices with the label of ``q``, and how many of them each further test rejects."""
    out, inc = p.out(q), p.inc(q)
    few = F.lit(False)
    for x in LABELS:
        for side, near in (("out", out), ("in", inc)):
            few |= F.col(f"{side}_{x}") < sum(p.labels[b] == x for b in near)
    return profiles.where(F.col("label") == p.labels[q]).agg(
        F.lit(q).alias("q"), F.count("*").alias("n_label"), F.count_if(F.col("out_deg") < len(out)).alias("n_out_degree"),
        F.count_if(F.col("in_deg") < len(inc)).alias("n_in_degree"), F.count_if(F.col("active_duration") < k).alias("n_duration"),
        F.count_if(few).alias("n_neighbours"))


def _arcs(durable: DataFrame, a: str, b: str) -> DataFrame:
    return durable.select(F.col("src").alias(a), F.col("dst").alias(b)).distinct()


def expand(p: Pattern, durable: DataFrame, parent: int, child: int, parents: DataFrame, children: DataFrame) -> DataFrame:
    """(v_par, v_cand): durable arcs from candidates of the parent to those of the child.

    Where the pattern has arcs both ways, both have to be durable.
    """
    pairs = None
    if (parent, child) in p.arcs:
        pairs = _arcs(durable, "v_par", "v_cand")
    if (child, parent) in p.arcs:
        back = _arcs(durable, "v_cand", "v_par")
        pairs = back if pairs is None else pairs.join(back, ["v_par", "v_cand"], "left_semi")
    pairs = pairs.join(parents.select(F.col("v").alias("v_par")), "v_par", "left_semi")
    return pairs.join(children.select(F.col("v").alias("v_cand")), "v_cand", "left_semi").select("v_par", "v_cand")


def has_closing_arc(p: Pattern, durable: DataFrame, q: int, other: int, cands: DataFrame, others: DataFrame) -> DataFrame:
    """Candidates (v) of ``q`` with a durable arc, for each pattern arc between the two, to some candidate of ``other``."""
    near = others.select(F.col("v").alias("w"))
    for a, b in ((q, other), (other, q)):
        if (a, b) in p.arcs:
            ends = _arcs(durable, "v", "w") if a == q else _arcs(durable, "w", "v")
            cands = cands.join(ends.join(near, "w", "left_semi"), "v", "left_semi")
    return cands


class CandidateTree:
    """Relations by pattern vertex; ``roots`` are the root's candidates."""

    def __init__(self, p: Pattern, d: Decomposition, roots: DataFrame, relations: dict[int, DataFrame]):
        self.p, self.d, self.roots, self.relations = p, d, roots, relations

    def of(self, q: int) -> DataFrame:
        """Distinct candidates (v) of ``q``."""
        return self.roots if q == self.d.root else self.relations[q].select(F.col("v_cand").alias("v")).distinct()

    def all(self) -> dict[int, DataFrame]:
        return {q: self.of(q) for q in self.d.order}


def build(g: TemporalGraph, p: Pattern, d: Decomposition, k: int, hold: Callable[[DataFrame, str], DataFrame] = keep) -> CandidateTree:
    """Relations in tree order, before trims. ``hold`` cuts the lineage of each relation."""
    profiles = hold(stats.profiles(g), "profiles")
    durable = g.durable(k)
    tree = CandidateTree(p, d, vertex_candidates(profiles, p, d.root, k), {})
    done = [d.root]
    for q in d.order[1:]:
        cands = vertex_candidates(profiles, p, q, k)
        for other in done:
            if other != d.parent[q] and any({*a} == {q, other} for a in d.non_tree):
                cands = has_closing_arc(p, durable, q, other, cands, tree.of(other))
        tree.relations[q] = hold(expand(p, durable, d.parent[q], q, tree.of(d.parent[q]), cands), "relation")
        done.append(q)
    return tree


def trim_bottom_up(t: CandidateTree, hold: Callable[[DataFrame, str], DataFrame] = keep) -> CandidateTree:
    """Keeps a candidate only if every child has a relation row under it."""
    roots, relations = t.roots, dict(t.relations)
    for q in reversed(t.d.order):
        for c in t.d.children[q]:
            under = relations[c].select(F.col("v_par").alias("v"))
            if q == t.d.root:
                roots = roots.join(under, "v", "left_semi")
            else:
                relations[q] = relations[q].join(under, relations[q]["v_cand"] == under["v"], "left_semi")
        if q != t.d.root and t.d.children[q]:
            relations[q] = hold(relations[q], "relation")
    return CandidateTree(t.p, t.d, hold(roots, "roots"), relations)


def trim_top_down(t: CandidateTree, hold: Callable[[DataFrame, str], DataFrame] = keep) -> CandidateTree:
    """Drops rows whose parent candidate is gone."""
    out = CandidateTree(t.p, t.d, t.roots, dict(t.relations))
    for q in t.d.order[1:]:
        alive = out.of(t.d.parent[q]).select(F.col("v").alias("v_par"))
        out.relations[q] = hold(out.relations[q].join(alive, "v_par", "left_semi"), "relation")
    return out


def reduced(g: TemporalGraph, p: Pattern, d: Decomposition, k: int) -> CandidateTree:
    return trim_top_down(trim_bottom_up(build(g, p, d, k)))


def summary(t: CandidateTree) -> DataFrame:
    """One row a pattern vertex: blocks, distinct candidates, relation entries."""
    out = t.roots.agg(F.lit(t.d.root).alias("q"), F.lit(0).cast("long").alias("n_blocks"), F.count_distinct("v").alias("n_candidates"), F.lit(0).cast("long").alias("n_entries"))
    for q in t.d.order[1:]:
        out = out.union(t.relations[q].agg(F.lit(q).alias("q"), F.count_distinct("v_par"), F.count_distinct("v_cand"), F.count("*")))
    return out


def sample(t: CandidateTree, q: int, n: int = 20) -> DataFrame:
    """The first ``n`` candidates in order."""
    return t.of(q).orderBy("v").limit(n)
