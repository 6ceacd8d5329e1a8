"""Query ``op5_licenses`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm import licenses


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus has no paths of its own: a document lies at source/lang/doc_id.txt."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", "text", F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"))
    return licenses.scan(docs)


def _sql() -> str:
    """The scan over every run of lines of every text, without anchors or any other shortcut."""
    tf = ", ".join(f"('{name}', {number}, '{w}', {c})" for name, number, t in licenses.template_words() for w, c in sorted(t.items()))
    split = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""WITH tpl(licence, number, word, c) AS (VALUES {tf}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS dir FROM documents),
da AS (SELECT rid, {split.format("t")} AS w FROM d),
df AS (SELECT word, count(*) AS n FROM (SELECT DISTINCT rid, unnest(w) AS word FROM da) GROUP BY word),
idf AS (SELECT word, ln((1 + (SELECT count(*) FROM d)) / (1.0 + coalesce(n, 0))) + 1 AS x FROM (SELECT word FROM tpl UNION SELECT word FROM df) LEFT JOIN df USING (word)),
tw AS (SELECT licence, number, word, c * x / sqrt(sum(c * x * c * x) OVER (PARTITION BY licence, number)) AS weight FROM tpl JOIN idf USING (word)),
sp AS (SELECT rid, string_split(t, chr(10)) AS ls FROM d),
st AS (SELECT rid, ls, unnest(range(len(ls))) AS s FROM sp),
wn AS (SELECT rid, ls, s, unnest(range(1, {licenses.LINES + 1})) AS n FROM st),
ln AS (SELECT rid, array_to_string(ls[s + 1:s + n], ' ') AS line FROM wn WHERE s + n <= len(ls)),
lw AS (SELECT row_number() OVER () AS unit, rid, {split.format("line")} AS w FROM ln),
tf AS (SELECT unit, word, count(*) AS c FROM (SELECT unit, unnest(w) AS word FROM lw) GROUP BY unit, word),
v AS (SELECT unit, word, tf.c * x AS x FROM tf JOIN idf USING (word)),
nm AS (SELECT unit, sqrt(sum(x * x)) AS norm FROM v GROUP BY unit),
sc AS (SELECT unit, licence, round(sum(v.x * weight) / any_value(norm), 6) AS score FROM v JOIN tw USING (word) JOIN nm USING (unit) GROUP BY unit, licence, number),
bu AS (SELECT unit, max(score) AS score, arg_min(licence, (-score, licence)) AS licence FROM sc WHERE score >= {licenses.THRESHOLD} GROUP BY unit),
own AS (SELECT rid, max(score) AS own_score, arg_min(licence, (-score, licence)) AS own_licence, max(len(w)) AS n_notice FROM bu JOIN lw USING (unit) GROUP BY rid),
e AS (SELECT d.rid, doc_id, path, dir, own_score, own_licence, n_notice, len(w) AS n_all FROM d JOIN da USING (rid) LEFT JOIN own USING (rid)),
dl AS (SELECT dir, arg_min(own_licence, (-own_score, path)) AS lic FROM e WHERE own_licence IS NOT NULL AND 2 * n_notice >= n_all GROUP BY dir)
SELECT doc_id, path, own_licence, own_score, coalesce(own_licence, lic) AS licence, CASE WHEN own_licence IS NULL AND lic IS NOT NULL THEN dir END AS inherited_from
FROM e LEFT JOIN dl USING (dir)"""


#: Licence files lie in source/lang only, so a directory above it never has one.
SQL = _sql()
