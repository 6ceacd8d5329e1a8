"""Statistics of a temporal graph: degrees, neighbour labels, durations, label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.functions import intervals as iv
from chronograft.operators.graph import TemporalGraph

LABELS = "ABCDE"


def vertices(g: TemporalGraph) -> DataFrame:
    """Ids of the graph's arcs, with labels."""
    arcs = g.arcs()
    return arcs.select(F.col("src").alias("id"), F.col("src_label").alias("label")).union(arcs.select(F.col("dst").alias("id"), F.col("dst_label").alias("label"))).distinct()


def degrees(g: TemporalGraph) -> DataFrame:
    """(id, label, out_deg, in_deg, out_A.., in_A..): distinct neighbours, in all and by label.

    Both directions are one union and one aggregate on the vertex.
    """
    arcs = g.arcs()
    side = lambda me, mine, other, out: arcs.select(
        F.col(me).alias("id"), F.col(mine).alias("label"), F.col(other).alias("near"), F.lit(out).alias("out"))
    both = side("src", "src_label", "dst_label", True).union(side("dst", "dst_label", "src_label", False))
    out, inc = F.col("out"), ~F.col("out")
    return both.groupBy("id", "label").agg(
        F.count_if(out).alias("out_deg"), F.count_if(inc).alias("in_deg"),
        *[F.count_if(out & (F.col("near") == x)).alias(f"out_{x}") for x in LABELS],
        *[F.count_if(inc & (F.col("near") == x)).alias(f"in_{x}") for x in LABELS])


def durations(g: TemporalGraph) -> DataFrame:
    """(id, label, active_duration): snapshots that the union of incident runs covers.

    Incident intervals are made distinct first, so a hub brings its distinct intervals, not its arcs.
    """
    side = lambda me, mine: g.runs.select(F.col(me).alias("id"), F.col(mine).alias("label"), "start", "end")
    incident = side("src", "src_label").union(side("dst", "dst_label"))
    runs = iv.merged(incident, ["id", "label"])
    return runs.groupBy("id", "label").agg(F.sum(iv.length(F.col("start"), F.col("end"))).alias("active_duration"))


def profiles(g: TemporalGraph) -> DataFrame:
    """Degrees and durations of each vertex, for candidate selection."""
    return degrees(g).join(durations(g).drop("label"), "id")


def label_counts(g: TemporalGraph) -> DataFrame:
    return vertices(g).groupBy("label").agg(F.count("*").alias("n"))


def label_lifespans(g: TemporalGraph) -> DataFrame:
    """(label, n, lifespan): vertices and their average active duration."""
    return durations(g).groupBy("label").agg(F.count("*").alias("n"), F.avg("active_duration").alias("lifespan"))


def label_tables(g: TemporalGraph) -> tuple[dict[str, int], dict[str, float]]:
    """Counts and lifespans of all labels on the driver, as many rows as there are labels; 0 if absent."""
    rows = {r["label"]: r for r in label_lifespans(g).collect()}
    names = sorted({*LABELS, *rows})
    return {x: rows[x]["n"] if x in rows else 0 for x in names}, {x: float(rows[x]["lifespan"]) if x in rows else 0.0 for x in names}


def match_counter(parts: list[int], limit: int = (1 << 64) - 1) -> tuple[int, bool]:
    """Sum of partial counts held at ``limit``, and whether it went over."""
    total = sum(parts)
    return min(total, limit), total > limit
