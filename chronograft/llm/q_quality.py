"""Query ``op8_quality_rules`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm import quality

POLICY = 2


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(F.col("failed"), 1)).alias("base_failed"),
        quality.passes(F.col("failed"), POLICY).alias("kept"),
        F.col("failed").alias("failed_bits"),
    )


#: Ledger of every document, as a chain of CTEs that ends in ``judged``.
LEDGER_SQL = r"""
src AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM documents),
cut AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
               string_split(t, chr(10)) AS lines FROM src),
tri AS (SELECT rid, unnest(range(len(w) - 2)) AS p, w FROM cut WHERE len(w) >= 3),
tri2 AS (SELECT rid, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS g FROM tri),
rep AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM tri2) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT q) AS r FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY rid),
meas AS (SELECT cut.*, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_bangs,
    len(lines)::BIGINT AS n_lines,
    (len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(r, 0)::BIGINT AS n_repeat_words
  FROM cut LEFT JOIN cov USING (rid)),
judged AS (SELECT *,
    (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
   + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
   + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
   + CASE WHEN 5 * n_dup_lines > 2 * n_lines THEN 8 ELSE 0 END
   + CASE WHEN word_chars < 3 * n_words OR word_chars > 10 * n_words THEN 16 ELSE 0 END
   + CASE WHEN 2 * n_bangs > n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM meas)
"""

SQL = f"""WITH {LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM judged"""


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, alone or at all, and what the others would without it."""
    led = quality.ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return quality.ablations(led, POLICY)


_RULES = ", ".join(f"('{rule}', {1 << quality.BITS[rule]})" for rule in quality.POLICIES[POLICY])
ABLATIONS_SQL = f"""WITH {LEDGER_SQL}, rules(rule, bit) AS (VALUES {_RULES})
SELECT rule, count(*) FILTER (failed_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (failed_bits = bit)::BIGINT AS n_alone,
  count(*) FILTER (failed_bits <> 0 AND failed_bits <> bit)::BIGINT AS n_rejected_without FROM judged, rules GROUP BY rule"""
