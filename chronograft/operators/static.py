"""Timestamp-free matching: exact, injective, directed, non-induced embeddings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.operators.matcher import arc_order, capped, within
from chronograft.plans.decompose import depth_first, matching_order, start_vertices
from chronograft.plans.pattern import Pattern, check

ARC_LABEL = "1"


def collapse(occurrences: DataFrame) -> DataFrame:
    """Distinct arcs (src, dst) without self-loops."""
    return occurrences.where("src <> dst").select("src", "dst").distinct()


def undirected(arcs: DataFrame) -> DataFrame:
    return arcs.select("src", "dst").union(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbour_labels(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, n): undirected neighbours of a vertex that carry a label."""
    near = undirected(arcs).join(labels.select(F.col("id").alias("dst"), "label"), "dst")
    return near.groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("n"))


def label_filter(arcs: DataFrame, labels: DataFrame, p: Pattern, q: int) -> DataFrame:
    """Vertices (v) with the label of ``q`` and at least its undirected neighbours by label."""
    out = labels.where(F.col("label") == p.labels[q]).select(F.col("id").alias("v")).distinct()
    need: dict[str, int] = {}
    for b in p.neighbours(q):
        need[p.labels[b]] = need.get(p.labels[b], 0) + 1
    counts = neighbour_labels(arcs, labels)
    for x, n in sorted(need.items()):
        enough = counts.where((F.col("label") == x) & (F.col("n") >= n)).select(F.col("id").alias("v"))
        out = out.join(enough, "v", "left_semi")
    return out


def start_vertex(arcs: DataFrame, labels: DataFrame, p: Pattern, most: int = 3) -> list[tuple[int, int, int]]:
    """(pattern vertex, vertices of its label, those that pass :func:`label_filter`) of the ``most`` vertices of
    least label count / degree, the one of fewest passing vertices first."""
    counts = {r[0]: r[1] for r in labels.groupBy("label").agg(F.count_distinct("id")).collect()}  # a row a label
    rows = [(q, counts.get(p.labels[q], 0), label_filter(arcs, labels, p, q).count()) for q in start_vertices(p, counts, most)]
    return sorted(rows, key=lambda r: r[2])


def search_order(p: Pattern, arcs: DataFrame, labels: DataFrame) -> list[tuple[int, int]]:
    """Arcs in the order in which :func:`matching_order` binds their ends, from the start vertex's tree."""
    sizes = {q: label_filter(arcs, labels, p, q).count() for q in range(p.n)}
    root = start_vertex(arcs, labels, p)[0][0]
    tree = depth_first(p, {q: float(n) if q != root else -1.0 for q, n in sizes.items()}, {})
    place = {q: i for i, q in enumerate(matching_order(tree, sizes))}
    return sorted(p.arcs, key=lambda a: (max(place[a[0]], place[a[1]]), min(place[a[0]], place[a[1]])))


def match(arcs: DataFrame, labels: DataFrame, p: Pattern, reduce: bool = False, order: list[tuple[int, int]] | None = None) -> DataFrame:
    """(q0..qn): all embeddings. ``labels`` (id, label) may give a vertex several labels.

    Data arcs carry the label 1 unless ``arcs`` has a column ``label``; a pattern arc that asks for a
    label only meets arcs that carry it. ``reduce`` first semi-joins vertices by neighbour labels;
    ``order`` is a connected order of the pattern's arcs, e.g. of :func:`search_order`.
    """
    check(p, single_vertex=True)
    if not p.arcs:
        return labels.where(F.col("label") == p.labels[0]).select(F.col("id").alias("q0")).distinct()
    if "label" not in arcs.columns:
        arcs = arcs.withColumn("label", F.lit(ARC_LABEL))
    asked = dict(zip(p.arcs, p.arc_labels, strict=True)) if p.arc_labels else {}
    out, bound = None, []
    for a, b in order or arc_order(p):
        leg = arcs.where(F.col("label") == asked[a, b]) if asked.get((a, b)) else arcs
        leg = leg.select(F.col("src").alias(f"l{a}"), F.col("dst").alias(f"l{b}") if a != b else F.col("dst").alias("l_loop"))
        if a == b:
            leg = leg.where(F.col(f"l{a}") == F.col("l_loop")).drop("l_loop")
        new = [q for q in dict.fromkeys((a, b)) if q not in bound]
        for q in new:  # a bound vertex has been tested where it was bound
            ids = label_filter(arcs, labels, p, q) if reduce else labels.where(F.col("label") == p.labels[q]).select(F.col("id").alias("v"))
            leg = leg.join(ids.select(F.col("v").alias(f"l{q}")), f"l{q}", "left_semi")
        if len(new) == 2:
            leg = leg.where(F.col(f"l{a}") != F.col(f"l{b}"))
        if out is None:
            out = leg.select(*[F.col(f"l{q}").alias(f"q{q}") for q in new])
        else:
            on = [F.col(f"q{q}") == F.col(f"l{q}") for q in dict.fromkeys((a, b)) if q in bound]
            on += [F.col(f"l{q}") != F.col(f"q{o}") for q in new for o in bound]
            out = out.join(leg, on).select(*[f"q{q}" for q in bound], *[F.col(f"l{q}").alias(f"q{q}") for q in new])
        bound += new
    return out.select(*[f"q{q}" for q in range(p.n)]).distinct()


def run(arcs: DataFrame, labels: DataFrame, p: Pattern, time_limit: float = 600, max_results: int | None = None) -> dict:
    """Count of embeddings with the usual limits: {count, timed_out, truncated}."""
    spark = arcs.sparkSession

    def work():
        found = match(arcs, labels, p)
        if max_results is None:
            return found.count(), False
        rows, more = capped(found, max_results)
        return len(rows), more

    result, late = within(spark, time_limit, work)
    n, more = result if result else (0, False)
    return {"count": n, "timed_out": late, "truncated": more}


def batch(graphs: Iterable[tuple[str, DataFrame, DataFrame]], patterns: Iterable[tuple[str, Pattern]], **limits) -> list[dict]:
    """All patterns on all data graphs, a summary each."""
    patterns = list(patterns)
    return [{"data": name, "query": q, **run(arcs, labels, p, **limits)} for name, arcs, labels in graphs for q, p in patterns]
