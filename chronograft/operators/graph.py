"""The temporal graph: runs of labelled arcs, from occurrences."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronograft.operators import snapshots
from chronograft.storage import keep


@dataclass(frozen=True)
class TemporalGraph:
    """``runs`` (src, dst, src_label, dst_label, start, end) and ``labels`` (id, label)."""

    runs: DataFrame
    labels: DataFrame

    @staticmethod
    def build(occurrences: DataFrame, labels: DataFrame, prefilter: bool = True) -> TemporalGraph:
        """Runs of distinct occurrences with the labels of both ends, written once.

        ``prefilter`` keeps an arc's whole history only if two of its snapshots are consecutive, and
        drops self-loops; it changes no match of two snapshots or more without self-loops.
        """
        runs = snapshots.islands(snapshots.dedup(occurrences))
        if prefilter:
            runs = snapshots.consecutive_only(runs)
        src = labels.select(F.col("id").alias("src"), F.col("label").alias("src_label"))
        dst = labels.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
        runs = runs.join(src, "src").join(dst, "dst").select("src", "dst", "src_label", "dst_label", "start", "end")
        return TemporalGraph(keep(runs, "graph"), labels)

    def durable(self, k: int) -> DataFrame:
        """Runs that last ``k`` snapshots."""
        return self.runs.where(F.col("end").cast("long") - F.col("start") + 1 >= k)

    def arcs(self) -> DataFrame:
        """Distinct arcs with their labels."""
        return self.runs.select("src", "dst", "src_label", "dst_label").distinct()
