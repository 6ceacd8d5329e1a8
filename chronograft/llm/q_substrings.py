"""Query ``op4_suffix_dedup`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronograft.llm import substrings


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substrings.repeats(docs, digest=True).withColumnRenamed("kept", "kept_sha256")


#: Every window by itself, over hexadecimal digits of the UTF-8 bytes.
SQL = """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT rid, unnest(range(length(h) // 2 - 199)) AS p FROM d WHERE length(h) >= 400),
g AS (SELECT w.rid, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM w JOIN d USING (rid)),
r AS (SELECT rid, p FROM g WHERE m IN (SELECT m FROM g GROUP BY m HAVING count(*) > 1)),
i AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
n AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM i),
k AS (SELECT rid, run, min(p) AS a, max(p) + 200 AS b FROM n GROUP BY rid, run),
kp AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS from_ FROM k),
kept AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
  string_agg(substr(h, (2 * from_ + 1)::BIGINT, (2 * (a - from_))::BIGINT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::BIGINT) AS left_
  FROM kp JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(left_, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (rid)"""
