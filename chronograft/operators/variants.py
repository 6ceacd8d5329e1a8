"""Variant semantics: direction-insensitive histories, total durability, one-hop blocks, tree arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronograft.functions import intervals as iv
from chronograft.operators import snapshots
from chronograft.operators.graph import TemporalGraph
from chronograft.plans.decompose import Decomposition
from chronograft.plans.pattern import Pattern


def vertex_stats(occurrences: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, label, out_deg, duration, n_near_labels) over out-neighbours.

    duration: distinct snapshots of a vertex's arcs to its out-neighbours, in both directions.
    """
    d = snapshots.dedup(occurrences)
    pairs = d.select("src", "dst").distinct()
    back = d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "t").join(pairs, ["src", "dst"], "left_semi")
    times = d.union(back).groupBy("src").agg(F.count_distinct("t").alias("duration"))
    near = pairs.join(labels.select(F.col("id").alias("dst"), F.col("label").alias("near")), "dst")
    deg = near.groupBy("src").agg(F.count("*").alias("out_deg"), F.count_distinct("near").alias("n_near_labels"))
    out = deg.join(times, "src").join(labels.withColumnRenamed("id", "src"), "src")
    return out.select(F.col("src").alias("id"), "label", "out_deg", "duration", "n_near_labels")


def root_filter(stats: DataFrame, p: Pattern, d: Decomposition, q: int, k: int, strict: bool = True) -> DataFrame:
    """Vertices (v) for a tree vertex: label and, if strict, degree and labels for its children, and duration."""
    n = len(d.children[q])
    test = F.col("label") == p.labels[q]
    if strict:
        test &= (F.col("out_deg") >= n) & (F.col("n_near_labels") >= n) & (F.col("duration") >= k)
    return stats.where(test).select(F.col("id").alias("v"))


def child_filter(occurrences: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """(v_par, v_cand): out-neighbours of parents that pass the child's filter."""
    arcs = occurrences.select(F.col("src").alias("v_par"), F.col("dst").alias("v_cand")).distinct()
    arcs = arcs.join(parents.select(F.col("v").alias("v_par")), "v_par", "left_semi")
    return arcs.join(children.select(F.col("v").alias("v_cand")), "v_cand", "left_semi").select("v_par", "v_cand")


def either_direction(occurrences: DataFrame) -> DataFrame:
    """Histories as an arc's own or, where it has none, its reverse's."""
    d = snapshots.dedup(occurrences)
    pairs = d.select("src", "dst").distinct()
    back = d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "t")
    return d.union(back.join(pairs, ["src", "dst"], "left_anti").select("src", "dst", "t"))


def either_direction_graph(occurrences: DataFrame, labels: DataFrame) -> TemporalGraph:
    return TemporalGraph.build(either_direction(occurrences).where("src <> dst"), labels, prefilter=False)


def undirected_graph(occurrences: DataFrame, labels: DataFrame, prefilter: bool = True) -> TemporalGraph:
    return TemporalGraph.build(snapshots.undirected(occurrences), labels, prefilter)


def time_sets(matches: DataFrame, k: int) -> DataFrame:
    """One row a mapping that has a run of ``k`` with the number of all its common snapshots, those of shorter runs too.

    ``matches`` are the runs of any length, i.e. of a match with k = 1.
    """
    names = [c for c in matches.columns if c.startswith("q")]
    length = iv.length(F.col("run_start"), F.col("run_end"))
    return matches.groupBy(*names).agg(F.sum(length).alias("n_snapshots"), F.max(length).alias("_longest")).where(F.col("_longest") >= k).drop("_longest")


def one_hop(g: TemporalGraph, p: Pattern, root: int, k: int) -> DataFrame:
    """(q, v_root, n_total): durable out-neighbours with the label of each pattern child of the root."""
    parts = None
    for q in p.out(root):
        rows = g.durable(k).where((F.col("src_label") == p.labels[root]) & (F.col("dst_label") == p.labels[q]))
        part = rows.groupBy(F.lit(q).alias("q"), F.col("src").alias("v_root")).agg(F.count_distinct("dst").alias("n_total"))
        parts = part if parts is None else parts.union(part)
    return parts


def limited_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """The first ``most`` blocks of each pattern vertex, for reports."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy("v_root"))
    return blocks.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def tree_arc_candidates(g: TemporalGraph, p: Pattern, d: Decomposition) -> DataFrame:
    """For each tree arc (parent, child): blocks (distinct parent ends) and candidate arcs in all."""
    out = None
    arcs = g.arcs()
    for child in d.order[1:]:
        parent = d.parent[child]
        fits = (F.col("src_label") == p.labels[parent]) & (F.col("dst_label") == p.labels[child])
        part = arcs.where(fits).agg(F.lit(parent).alias("q_parent"), F.lit(child).alias("q_child"), F.count_distinct("src").alias("n_blocks"), F.count("*").alias("n_arcs"))
        out = part if out is None else out.union(part)
    return out


def path_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Natural join of partial matches on the pattern vertices they share."""
    return left.join(right, [c for c in left.columns if c in right.columns])
