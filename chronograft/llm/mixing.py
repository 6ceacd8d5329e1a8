"""Mixing sources to target weights by Pareto order sampling.

A source's target in words is its weighted share of all words, at most ``max_repeats`` times what
it holds; the excess goes to the others by weight until none is above. Every document is first
given the whole copies that all documents of its source are certain of. What is still needed is a
sample without replacement: documents are ranked by random odds over inclusion odds and taken in
that order until the words are nearest to the need. The inclusion probability of a document
follows its measure, by default the bit length of its size, so it is unequal within a source. Where that
would be above 1, documents are certain, and the others' probabilities are raised until the
expected words are the words needed: p = min(1, level * measure). The level is solved for from the words that a
source holds of each measure, a few dozen rows.

The rank is found without sorting a source. Ranks fall into fixed bins, words are summed by source
and bin, and only the one bin in which a source's need ends is put in order. A hot source is thus
never brought into one task. What is summed up in one task is one row a source (targets) and one row a measure
or bin of one source.

Defined cases: null text has size 0; null sources form a source of their own, sorted last; random
numbers hang on the seed, the id and the text, so reruns agree, rows of one id or without one are drawn apart, and rows
equal in both are interchangeable; ties in rank are ordered by id and digest, then size; a source without
words gets target 0; an empty table gives an empty mix; texts of any length are counted whole. Input columns may have
any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronograft.llm.text import packed, unpacked, word_count
from chronograft.storage import keep

BINS = 1 << 12
DEFAULT_WEIGHTS = (1, 2, 3)


def targets(totals: DataFrame, weights: tuple[int, ...] = DEFAULT_WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """Adds ``weight`` and ``target`` to one row a source: (source, source_size, ...).

    Water-filling in closed form. With sources ordered by the level at which they are full, the
    level that gives all words out is the greatest of (words left) / (weights left).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("weight", cycle.cast("long"))
    full = Window.orderBy(F.col("full_at").asc(), F.col("source").asc_nulls_last())
    before, everything = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("full_at", (max_repeats * F.col("source_size")).cast("double") / F.col("weight"))
    capped = F.coalesce(F.sum(max_repeats * F.col("source_size")).over(before), F.lit(0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0))
    left = F.sum("source_size").over(everything) - capped
    t = t.withColumn("level_here", left.cast("double") / (F.sum("weight").over(everything) - used))
    t = t.withColumn("level", F.max("level_here").over(everything))
    target = F.least(F.col("weight") * F.col("level"), (max_repeats * F.col("source_size")).cast("double"))
    return t.withColumn("target", target).drop("full_at", "level_here", "level")


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _levels(measures: DataFrame, plan: DataFrame) -> DataFrame:
    """(level_source, level): of which ``min(1, level * measure)`` is the inclusion probability in each source.

    If the documents of the j largest measures are certain, the level is (need - their words) / (sum of measure * words of
    the rest). Any choice of j expects too many words for a given level, so none gives a level too high, and the right
    one is the greatest.
    """
    m = measures.join(plan.select("plan_source", "need"), _same("source", "plan_source")).where("need > 0 and words > 0")
    larger = Window.partitionBy("source").orderBy(F.col("measure").desc())
    sure = F.coalesce(F.sum("words").over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("measure")).over(larger.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    each = m.withColumn("level", (F.col("need") - sure) / rest)
    return each.groupBy(F.col("source").alias("level_source")).agg(F.max("level").alias("level"))


def _planned(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Adds source_size, target, whole, need and the inclusion probability p to rows that have source, size and measure."""
    measures = keep(sizes.groupBy("source", "measure").agg(F.sum("size").alias("words")), "mix-measures")
    plan = targets(measures.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_repeats)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.floor(ratio)).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = keep(plan.withColumnRenamed("source", "plan_source"), "mix-targets")
    # written, so that its size is known: Spark broadcasts it where it is small and doesn't deal rows by source
    plan = keep(plan.join(_levels(measures, plan), _same("plan_source", "level_source"), "left").drop("level_source"), "mix-plan")
    d = sizes.join(plan, _same("source", "plan_source"), "left").drop("plan_source")
    return d.withColumn("p", F.least(F.lit(1.0), F.coalesce("level", F.lit(0.0)) * F.col("measure"))).drop("level")


def _copies(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int, seed: int) -> DataFrame:
    """Adds source_size, target and copies to rows that have key, source, size and measure."""
    d = _planned(sizes, weights, max_repeats)
    u = _uniform(F.lit(str(seed)), F.col("key"))
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rank = F.when(F.col("p") <= 0, F.lit(1.0)).when(F.col("p") >= 1, F.lit(0.0)).otherwise(F.col("odds") / (1 + F.col("odds")))
    d = d.withColumn("odds", F.when((F.col("p") > 0) & (F.col("p") < 1), odds)).withColumn("rank", rank)
    d = d.withColumn("bin", F.floor(F.col("rank") * F.lit(float(BINS))))

    bins = d.where("need > 0").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("need").alias("n"))
    in_order = Window.partitionBy("source").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("words").over(in_order))
    edge = bins.where((F.col("upto") > F.col("n")) & (F.col("upto") - F.col("words") <= F.col("n"))).groupBy("source").agg(
        F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    edge = keep(edge.select(F.col("source").alias("edge_source"), F.col("e.bin").alias("edge_bin"), F.col("e.before").alias("before")), "mix-edge")

    d = d.join(edge, _same("source", "edge_source"), "left").drop("edge_source")
    at_edge = F.col("edge_bin").isNotNull() & (F.col("bin") == F.col("edge_bin"))
    settled = d.where(~F.coalesce(at_edge, F.lit(False))).withColumn(
        "sampled", (F.col("need") > 0) & (F.col("edge_bin").isNull() | (F.col("bin") < F.col("edge_bin"))))
    ranked = Window.partitionBy("source").orderBy("rank", "key", "size")
    upto = F.col("before") + F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    ordered = d.where(F.coalesce(at_edge, F.lit(False))).withColumn("sampled", 2 * upto - F.col("size") <= 2 * F.col("need"))
    both = settled.unionByName(ordered)
    return both.withColumn("copies", F.coalesce(F.col("whole"), F.lit(0)) + F.when(F.col("sampled"), 1).otherwise(0))


def _key(id_col: str, text_col: str) -> Column:
    """A row's draw: its id and its text."""
    return F.concat_ws(":", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The narrow table that all passes read: an opaque key for ties, the source and the size."""
    size = word_count(F.col(f"`{text_col}`"))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), _key(id_col, text_col).alias("key"), size.alias("size")
    ).withColumn("measure", F.length(F.bin(F.col("size"))).cast("long"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = DEFAULT_WEIGHTS, max_repeats: int = 3, seed: int = 7,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each input row: id, source, size, source_size, target and copies."""
    sizes = keep(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    out = _copies(sizes, weights, max_repeats, seed)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = DEFAULT_WEIGHTS, max_repeats: int = 3, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each input row, with all its columns, as often as it has copies."""
    sized = _sized(docs, id_col, text_col, source_col).select("key", "source", "size", "measure")
    sizes = keep(sized, "mix-sizes")
    copies = _copies(sizes, weights, max_repeats, seed).select("key", "source", "copies")
    # rows that tie in both are interchangeable up to their other columns; they are numbered apart
    tie = Window.partitionBy("key", "source").orderBy(F.col("copies").desc())
    copies = copies.withColumn("n", F.row_number().over(tie)).select(F.col("key").alias("k"), F.col("source").alias("s"), "n", "copies")
    rows = packed(docs, _key(id_col, text_col).alias("key"), F.col(f"`{source_col}`").alias("source"))
    rows = rows.withColumn("m", F.row_number().over(Window.partitionBy("key", "source").orderBy("key")))
    out = rows.join(copies, [F.col("key") == F.col("k"), F.col("source").eqNullSafe(F.col("s")), F.col("m") == F.col("n")]).where("copies > 0")
    return unpacked(out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))), docs.schema)
