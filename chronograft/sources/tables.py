"""Temporal graphs derived from ordinary tables: (src, dst, t) occurrences and natural labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronograft.operators.graph import TemporalGraph


def _period(date: Column, grain: str) -> Column:
    year = F.year(date)
    return {"month": year * 12 + F.month(date), "quarter": year * 4 + F.quarter(date), "year": year}[grain].cast("int")


def trade_occurrences(spark: SparkSession, sf_dir: str, grain: str = "quarter") -> DataFrame:
    """Customer nation -> supplier nation in each period with a shipment.

    The dimension joins come down to nation keys before the fact rows are made distinct.
    """
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    buyer = read("orders", "o_orderkey", "o_custkey").join(read("customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    items = read("lineitem", "l_orderkey", "l_suppkey", "l_shipdate")
    seller = read("supplier", "s_suppkey", "s_nationkey")
    rows = items.join(seller, F.col("l_suppkey") == F.col("s_suppkey")).join(buyer, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), _period(F.col("l_shipdate"), grain).alias("t"))


def nation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's label is its region, A to E."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nations.select(F.col("n_nationkey").cast("long").alias("id"), F.char((F.col("n_regionkey") + 65).cast("int")).alias("label"))


def trade(spark: SparkSession, sf_dir: str, grain: str = "quarter", prefilter: bool = True) -> TemporalGraph:
    return TemporalGraph.build(trade_occurrences(spark, sf_dir, grain), nation_labels(spark, sf_dir), prefilter)


def hop_occurrences(spark: SparkSession, sf_dir: str, groups: int = 40) -> DataFrame:
    """User group -> group of the day's next event, by (ts, event_id); t counts days."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", (F.col("user_id") % groups).alias("src"))
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    e = e.withColumn("t", day)
    following = F.lead("src").over(Window.partitionBy("t").orderBy("ts", "event_id"))
    return e.select(F.col("src").cast("long").alias("src"), following.cast("long").alias("dst"), "t").where("dst is not null")


def hops(spark: SparkSession, sf_dir: str, groups: int = 40, prefilter: bool = True) -> TemporalGraph:
    occurrences = hop_occurrences(spark, sf_dir, groups)
    ids = spark.range(groups).select("id", F.char((F.col("id") % 5 + 65).cast("int")).alias("label"))
    return TemporalGraph.build(occurrences, ids, prefilter)


def unix_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as Unix-time arcs: user -> event id modulo 100 at a second."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").cast("long").alias("src"), (F.col("event_id") % 100).cast("long").alias("dst"), seconds.alias("t"), "event_id")
