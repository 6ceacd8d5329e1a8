"""Query ``op10_html_text``; tests hold it against pages of known text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm import html


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html.main_text(pages).select("doc.page_id", "doc.url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
