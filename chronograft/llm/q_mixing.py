"""Query ``op3_mixing`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm import mixing


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    planned = mixing.plan_mix(docs)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("copies").cast("long").alias("copies"))


#: Ends in ``copied``: (doc_id, source, size, source_size, target, copies) of the table {docs}.
MIX_SQL = r"""
sz AS (SELECT doc_id, source, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS key,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM {docs}),
szm AS (SELECT *, length(bin(size))::BIGINT AS measure FROM sz),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM szm GROUP BY source),
wt AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM tot),
lev AS (SELECT *, (3 * source_size)::DOUBLE / weight AS full_at FROM wt),
lev2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS here FROM lev
    WINDOW b AS (ORDER BY full_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tg AS (SELECT *, least(weight * max(here) OVER (), (3 * source_size)::DOUBLE) AS target FROM lev2),
pl AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM tg),
pn AS (SELECT *, target - whole * source_size AS need FROM pl),
ms AS (SELECT source, measure, sum(size)::BIGINT AS words FROM szm GROUP BY source, measure HAVING sum(size) > 0),
lv AS (SELECT a.source, a.measure,
    (any_value(need) - coalesce(sum(b.words) FILTER (b.measure > a.measure), 0)) / sum(b.words * b.measure) FILTER (b.measure <= a.measure) AS lvl
  FROM ms a JOIN ms b ON a.source IS NOT DISTINCT FROM b.source JOIN pn ON pn.source IS NOT DISTINCT FROM a.source WHERE need > 0 GROUP BY a.source, a.measure),
lm AS (SELECT source, max(lvl) AS lvl FROM lv GROUP BY source),
pm AS (SELECT pn.*, lvl FROM pn LEFT JOIN lm ON pn.source IS NOT DISTINCT FROM lm.source),
j AS (SELECT szm.*, source_size, target, whole, need,
    least(1.0::DOUBLE, coalesce(lvl, 0.0) * measure) AS p,
    (('0x' || substr(md5('7:' || key), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM szm JOIN pm ON szm.source IS NOT DISTINCT FROM pm.source),
jr AS (SELECT *, CASE WHEN p <= 0 THEN 1.0 WHEN p >= 1 THEN 0.0
    ELSE ((u / (1 - u)) / (p / (1 - p))) / (1 + (u / (1 - u)) / (p / (1 - p))) END AS rnk FROM j),
jc AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rnk, key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM jr),
copied AS (SELECT doc_id, source, size, source_size, target,
    (whole + CASE WHEN need > 0 AND 2 * upto - size <= 2 * need THEN 1 ELSE 0 END)::BIGINT AS copies FROM jc)
"""

SQL = f"""WITH {MIX_SQL.replace("{docs}", "documents")}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM copied"""
