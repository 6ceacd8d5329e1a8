"""Durable pattern matching as a left-deep chain of equi-joins over arc runs.

One leg per pattern arc holds the runs with its labels that last ``k`` snapshots. Legs join on the
vertices they share with what is bound; the join condition carries the interval overlap, so a
partial match keeps the intersection of its runs and dies when it falls below ``k``. Runs of an
arc are disjoint and not adjacent, so a row is one (mapping, common run) and nothing is made
distinct. Arcs whose ends are both bound close first; then the smallest leg goes next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.functions import intervals as iv
from chronograft.operators.graph import TemporalGraph
from chronograft.plans.pattern import Pattern, check


def leg_sizes(g: TemporalGraph, k: int) -> dict[tuple[str, str], int]:
    """Durable runs by label pair: one aggregate, as many rows as there are label pairs."""
    rows = g.durable(k).groupBy("src_label", "dst_label").agg(F.count("*").alias("n")).collect()
    return {(r[0], r[1]): r[2] for r in rows}


def arc_order(p: Pattern, sizes: dict[tuple[str, str], int] | None = None) -> list[tuple[int, int]]:
    """Connected order of the pattern's arcs: closing arcs at once, else the smallest leg."""
    size = lambda a: (sizes or {}).get((p.labels[a[0]], p.labels[a[1]]), 0) if sizes is not None else 0
    left = list(p.arcs)
    out, bound = [], set()
    while left:
        near = [a for a in left if not bound or a[0] in bound or a[1] in bound]
        best = min(near, key=lambda a: (not {*a} <= bound if bound else True, size(a), p.arcs.index(a)))
        out.append(best)
        bound.update(best)
        left.remove(best)
    return out


def _leg(runs: DataFrame, p: Pattern, arc: tuple[int, int], n: int) -> DataFrame:
    a, b = arc
    rows = runs.where((F.col("src_label") == p.labels[a]) & (F.col("dst_label") == p.labels[b]))
    rows = rows.where("src = dst") if a == b else rows.where("src <> dst") if p.labels[a] == p.labels[b] else rows
    ends = [F.col("src").alias(f"l{a}")] + ([F.col("dst").alias(f"l{b}")] if a != b else [])
    return rows.select(*ends, F.col("start").alias(f"s{n}"), F.col("end").alias(f"e{n}"))


def match(g: TemporalGraph, p: Pattern, k: int, order: list[tuple[int, int]] | None = None, candidates: dict[int, DataFrame] | None = None,
          durability: str = "consecutive") -> DataFrame:
    """(q0..qn, run_start, run_end): each injective, label-preserving mapping and each of its common
    runs of ``k`` snapshots or more.

    candidates: by pattern vertex, ids (column ``v``) that its matches have to be among.
    durability: ``consecutive``, or ``total`` for ``k`` common snapshots in all; then there is one
    row a mapping, with ``n_snapshots``.
    """
    check(p, k)
    total = durability == "total"
    runs = g.runs if total else g.durable(k)
    least = 1 if total else k
    out, bound = None, []
    for n, (a, b) in enumerate(order or arc_order(p)):
        leg = _leg(runs, p, (a, b), n)
        for q in {a, b} if candidates else ():
            if q in candidates:
                leg = leg.join(candidates[q].select(F.col("v").alias(f"l{q}")), f"l{q}", "left_semi")
        new = [q for q in dict.fromkeys((a, b)) if q not in bound]
        if out is None:
            out = leg.select(*[F.col(f"l{q}").alias(f"q{q}") for q in new], F.col("s0").alias("s"), F.col("e0").alias("e"))
        else:
            on = [F.col(f"q{q}") == F.col(f"l{q}") for q in dict.fromkeys((a, b)) if q in bound]
            on.append(iv.overlap_at_least(F.col("s"), F.col("e"), F.col(f"s{n}"), F.col(f"e{n}"), least))
            on += [F.col(f"l{q}") != F.col(f"q{o}") for q in new for o in bound if p.labels[o] == p.labels[q]]
            joined = out.join(leg, on)
            out = joined.select(
                *[F.col(f"q{q}") for q in bound], *[F.col(f"l{q}").alias(f"q{q}") for q in new],
                F.greatest("s", f"s{n}").alias("s"), F.least("e", f"e{n}").alias("e"))
        bound += new
    names = [f"q{q}" for q in range(p.n)]
    if total:
        spans = out.groupBy(*names).agg(F.sum(iv.length(F.col("s"), F.col("e"))).alias("n_snapshots"))
        return spans.where(F.col("n_snapshots") >= k)
    return out.select(*names, F.col("s").alias("run_start"), F.col("e").alias("run_end"))


def mappings(matches: DataFrame) -> DataFrame:
    """One row a mapping, with its runs as an array and as text ``[1-3, 5]``."""
    names = [c for c in matches.columns if c.startswith("q")]
    folded = matches.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct(F.col("run_start").alias("start"), F.col("run_end").alias("end")))).alias("active"))
    return folded.withColumn("active_text", iv.format_intervals(F.col("active")))


def count(matches: DataFrame) -> DataFrame:
    """One row: the exact number of mappings, held at 2^64 - 1, and whether it went over."""
    names = [c for c in matches.columns if c.startswith("q")]
    limit = F.lit("18446744073709551615").cast("decimal(20,0)")
    n = matches.select(*names).distinct().agg(F.count("*").cast("decimal(20,0)").alias("n"))
    return n.select(F.least("n", limit).alias("n_matches"), (F.col("n") > limit).alias("overflow"))


def capped(matches: DataFrame, most: int) -> tuple[list, bool]:
    """Up to ``most`` rows, and whether there are more."""
    rows = matches.limit(most + 1).collect()
    return rows[:most], len(rows) > most


def within(spark, seconds: float, work):
    """(result of ``work()``, timed out): jobs it starts are cancelled at the deadline; 0 is none."""
    import threading

    if not seconds:
        return work(), False
    group, late = f"deadline-{uuid.uuid4().hex}", threading.Event()
    context = spark.sparkContext

    def stop():
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, "work with a deadline", interruptOnCancel=True)
    timer.start()
    try:
        return work(), False
    except Exception:
        if late.is_set():
            return None, True
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)
