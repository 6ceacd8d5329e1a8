"""Inclusive snapshot intervals: row form (start, end columns) and array form (array of structs).

The row form is the physical default: its predicates stay in generated code. The array form serves
folded results and histories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVALS = "array<struct<start:int,end:int>>"


def length(start: Column, end: Column) -> Column:
    """Snapshots in an interval; 0 where it ends before it starts. Longs, so extremes don't overflow."""
    return F.greatest(end.cast("long") - start.cast("long") + 1, F.lit(0).cast("long"))


def overlap_at_least(s1: Column, e1: Column, s2: Column, e2: Column, k: int) -> Column:
    return F.least(e1, e2).cast("long") - F.greatest(s1, s2).cast("long") + 1 >= k


def intersect(a: Column, b: Column, least: int = 1) -> Column:
    """Pieces of ``least`` snapshots or more that two lists of disjoint intervals share, in order."""
    pieces = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(
        F.greatest(x["start"], y["start"]).alias("start"), F.least(x["end"], y["end"]).alias("end")))))
    return F.array_sort(F.filter(pieces, lambda p: p["end"].cast("long") - p["start"] + 1 >= max(least, 1)))


def has_run(intervals: Column, k: int) -> Column:
    """Whether an interval lasts ``k`` snapshots; any list does for k of 0 or less."""
    return F.lit(True) if k <= 0 else F.exists(intervals, lambda x: x["end"].cast("long") - x["start"] + 1 >= k)


def max_run(intervals: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(intervals, lambda x: x["end"].cast("long") - x["start"] + 1)), F.lit(0).cast("long"))


def union_duration(intervals: Column) -> Column:
    """Snapshots that a list of intervals covers, overlapping and adjacent ones once."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("upto"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("long"), x["end"].cast("long") - F.greatest(x["start"].cast("long") - 1, F.coalesce(a["upto"], x["start"].cast("long") - 1)))).alias("n"),
        F.greatest(a["upto"], x["end"].cast("long")).alias("upto"),
    )
    return F.aggregate(F.array_sort(intervals), start, step, lambda a: a["n"])


def format_intervals(intervals: Column) -> Column:
    """``[1-3, 5]``."""
    one = lambda x: F.when(x["start"] == x["end"], x["start"].cast("string")).otherwise(F.concat_ws("-", x["start"], x["end"]))
    return F.concat(F.lit("["), F.array_join(F.transform(intervals, one), ", "), F.lit("]"))


def runs_of(times: Column) -> Column:
    """The maximal runs (start, end) of an array of snapshots in any order, repeats included."""
    def cut(t: Column) -> Column:
        first = F.filter(t, lambda x, i: F.coalesce(F.get(t, i - 1) != x - 1, F.lit(True)))
        last = F.filter(t, lambda x, i: F.coalesce(F.get(t, i + 1) != x + 1, F.lit(True)))
        return F.transform(F.arrays_zip(first.alias("start"), last.alias("end")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    # within the lambda the sorted array is a value and not an expression for each element
    return F.element_at(F.transform(F.array(F.array_sort(F.array_distinct(times))), cut), 1)


def format_times(times: Column) -> Column:
    """An array of snapshots as ``[1-3, 5]``."""
    return format_intervals(runs_of(times))


def islands(df: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Maximal runs (keys, start, end) of distinct (keys, t) rows: consecutive snapshots share t - rank."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(t))
    grouped = df.select(*keys, F.col(t), (F.col(t).cast("long") - rank).alias("_island")).groupBy(*keys, "_island")
    return grouped.agg(F.min(t).alias("start"), F.max(t).alias("end")).drop("_island")


def merged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or adjacent intervals (keys, start, end) merged into maximal ones."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = df.distinct().withColumn("_new", F.when(reach.isNull() | (F.col("start").cast("long") > reach.cast("long") + 1), 1).otherwise(0))
    grouped = first.withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "_part")
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_part")


def label_code(label: Column) -> Column:
    """A..E as 0..4, anything else null."""
    return F.when(label.rlike("^[A-E]$"), F.ascii(label) - 65)


def label_of(code: Column) -> Column:
    """0..4 as A..E, anything else ``?``."""
    return F.when((code >= 0) & (code <= 4), F.char(code + 65)).otherwise("?")


def time_instance(t: Column, base: Column, minutes: int) -> Column:
    """Snapshot index of a Unix time: whole intervals since the base, from 1; division truncates."""
    return F.expr("1L") + _div(t - base, minutes * 60)


def _div(a: Column, b: int) -> Column:
    q = F.floor(F.abs(a) / F.lit(b))
    return F.when(a < 0, -q).otherwise(q).cast("long")
