"""Query ``op2_decontaminate`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm import decontaminate as d


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = d.contamination(docs, d.read_benchmark(spark, sf_dir))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (n >= d.MIN_ITEMS).alias("contaminated"))


def _split(text: str) -> str:
    folded = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"list_filter(regexp_split_to_array({folded}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


#: Ends in ``judged``: one row for each row of {docs}, with rid, n_words, n_hit and the items.
JUDGED_SQL = """
bw AS (SELECT item_id::VARCHAR AS item, {bench_words} AS w FROM benchmark WHERE item_id IS NOT NULL),
bs AS (SELECT item, w, least(8, len(w)) AS k FROM bw WHERE len(w) > 0),
bp AS (SELECT item, w, k, unnest(range(len(w) - k + 1)) AS p FROM bs),
win AS (SELECT DISTINCT item, k, array_to_string(w[p + 1:p + k], ' ') AS g FROM bp),
dw AS (SELECT row_number() OVER () AS rid, *, {doc_words} AS w FROM {docs}),
ks AS (SELECT DISTINCT k FROM win),
dp AS (SELECT rid, k, w, unnest(range(len(w) - k + 1)) AS p FROM dw, ks WHERE len(w) >= k),
hit AS (SELECT rid, item, p, dp.k FROM dp JOIN win ON dp.k = win.k AND array_to_string(w[p + 1:p + dp.k], ' ') = g),
hw AS (SELECT rid, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM hit) GROUP BY rid),
hi AS (SELECT rid, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid),
judged AS (SELECT dw.*, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items, '') AS items FROM dw LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid))
""".replace("{bench_words}", _split("text")).replace("{doc_words}", _split("text"))

SQL = f"""WITH {JUDGED_SQL.replace("{docs}", "documents")}
SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, n_items >= 2 AS contaminated FROM judged"""
