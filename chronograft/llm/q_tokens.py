"""Query ``op6_token_output``; tests hold it against the tokenizer and an exact round trip."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm import tokens


def digest(docs: DataFrame) -> DataFrame:
    """Written to shards and read back: doc_id, start, n_tokens and the crc32 of the ids."""
    manifest = tokens.write_tokens(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = tokens.read_tokens(manifest, kind, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "long")
    return read.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("value").alias("ids_crc32"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
