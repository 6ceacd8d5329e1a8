"""Query ``op9_secrets``; offsets of matches have no SQL, tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm import secrets


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in secrets.KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner, a language of a source one of its repositories."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.col("source").alias("owner"), F.concat_ws("/", "source", "lang").alias("repo"))
    base = F.filter("spans", lambda x: x["kind"] < secrets.N_BASE)
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return secrets.scan(docs).select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(_told(base), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda x: ~x["live"])).cast("long").alias("n_copied"))
