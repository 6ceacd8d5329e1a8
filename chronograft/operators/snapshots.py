"""Snapshot merge and dataset tools: occurrences to runs, filters, histories and time bucketing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronograft.functions import intervals as iv


def dedup(occurrences: DataFrame) -> DataFrame:
    """Each (src, dst, t) once."""
    return occurrences.select("src", "dst", "t").distinct()


def islands(distinct: DataFrame) -> DataFrame:
    """Maximal runs (src, dst, start, end) of distinct occurrences."""
    return iv.islands(distinct, ["src", "dst"])


def consecutive_only(runs: DataFrame, drop_loops: bool = True) -> DataFrame:
    """All runs of the arcs of which one run lasts two snapshots or more.

    A window over an arc's runs, on the partitioning that the islands already have.
    """
    longest = F.max(F.col("end").cast("long") - F.col("start") + 1).over(Window.partitionBy("src", "dst"))
    kept = runs.withColumn("_longest", longest).where("_longest >= 2").drop("_longest")
    return kept.where("src <> dst") if drop_loops else kept


def active_count(runs: DataFrame) -> DataFrame:
    """(src, dst, n_active): distinct snapshots of each arc."""
    return runs.groupBy("src", "dst").agg(F.sum(iv.length(F.col("start"), F.col("end"))).alias("n_active"))


def universe(occurrences: DataFrame) -> DataFrame:
    """Distinct endpoints of the raw input."""
    return occurrences.select(F.col("src").alias("id")).union(occurrences.select(F.col("dst").alias("id"))).distinct()


def arc_arrays(runs: DataFrame) -> DataFrame:
    """(src, dst, intervals, n_active): the array form of histories."""
    n = F.sum(iv.length(F.col("start"), F.col("end"))).alias("n_active")
    return runs.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("intervals"), n)


def expand(runs: DataFrame) -> DataFrame:
    """Runs back to occurrences."""
    return runs.select(*[c for c in runs.columns if c not in ("start", "end")], F.explode(F.sequence("start", "end")).alias("t"))


def undirected(occurrences: DataFrame) -> DataFrame:
    """Occurrences of unordered pairs, as both of their directions."""
    swapped = occurrences.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "t")
    return occurrences.select("src", "dst", "t").union(swapped).distinct()


def counters(occurrences: DataFrame, retained: DataFrame) -> DataFrame:
    """One row: occurrences, distinct pairs, retained pairs and active vertices."""
    pairs = retained.select("src", "dst").distinct()
    left = occurrences.agg(F.count("*").alias("n_occurrences"), F.count_distinct("src", "dst").alias("n_pairs"))
    kept = pairs.agg(F.count("*").alias("n_retained"))
    active = universe(pairs).agg(F.count("*").alias("n_vertices"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(left).join(one(kept), "_one").join(one(active), "_one").drop("_one")


# dataset tools


def bucket(rows: DataFrame, minutes: int, base: int | None = None, order: str | None = None) -> DataFrame:
    """Unix times to snapshot indices from 1. The base is the first row's time, floored to the interval.

    ``order`` names the column that tells the first row (a line number); the base is one aggregate.
    """
    if base is None:
        first = rows.agg(F.min_by("t", order) if order else F.min("t")).first()[0]
        base = 0 if first is None else int(first) - int(first) % (minutes * 60)
    return rows.withColumn("t", iv.time_instance(F.col("t"), F.lit(base).cast("long"), minutes))


def bucket_unique(rows: DataFrame, minutes: int, base: int | None = None, order: str | None = None) -> DataFrame:
    return bucket(rows, minutes, base, order).select("src", "dst", "t").distinct()


def timestamps(rows: DataFrame) -> DataFrame:
    """Unix times as ``YYYY-MM-DD HH:MM:SS`` in the session's time zone."""
    return rows.withColumn("t", F.from_unixtime("t", "yyyy-MM-dd HH:mm:ss"))


def unique_lines(lines: DataFrame, order: str = "line_no", value: str = "value") -> DataFrame:
    """Each line once, at its first place."""
    return lines.groupBy(value).agg(F.min(order).alias(order))


def filter_consecutive(occurrences: DataFrame) -> DataFrame:
    """Occurrences of arcs with two consecutive snapshots; self-loops stay."""
    return expand(consecutive_only(islands(dedup(occurrences)), drop_loops=False))


def filter_counts(lines: DataFrame) -> DataFrame:
    """One row of a filter's report over lines (value) ``src dst t``: lines that are no row, arcs, arcs kept.

    Blank lines count nowhere; what follows three integers is passed over.
    """
    grammar = r"^\s*([+-]?\d+)\s+([+-]?\d+)\s+([+-]?\d+)"
    number = lambda i, kind: F.regexp_extract("value", grammar, i).try_cast(kind)
    rows = lines.where(~F.col("value").rlike(r"^\s*$")).select(number(1, "long").alias("src"), number(2, "long").alias("dst"), number(3, "int").alias("t"))
    bad = F.col("src").isNull() | F.col("dst").isNull() | F.col("t").isNull()
    odd = rows.agg(F.count_if(bad).alias("n_invalid"))
    longest = F.max(iv.length(F.col("start"), F.col("end"))).alias("longest")
    arcs = islands(dedup(rows.where(~bad))).groupBy("src", "dst").agg(longest)
    kept = arcs.agg(F.count("*").alias("n_arcs"), F.count_if(F.col("longest") >= 2).alias("n_kept"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(odd).join(one(kept), "_one").drop("_one")


def history(occurrences: DataFrame) -> DataFrame:
    """(src, dst, times): comma list of an arc's snapshots, sorted, repeats kept."""
    return occurrences.groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_list("t")), ",").alias("times"))


def count_durable(histories: DataFrame) -> DataFrame:
    """One row: arcs of a history dump and those with two consecutive snapshots.

    ``times`` may be the text form or an array.
    """
    times = F.col("times") if dict(histories.dtypes)["times"].startswith("array") else F.split("times", ",").cast("array<int>")
    sorted_ = F.array_sort(F.array_distinct(times))
    durable = F.exists(F.zip_with(sorted_, F.slice(sorted_, F.lit(2), F.greatest(F.size(sorted_), F.lit(1))), lambda a, b: b - a == 1), lambda x: F.coalesce(x, F.lit(False)))
    return histories.agg(F.count("*").alias("n_arcs"), F.count_if(durable).alias("n_durable"))
