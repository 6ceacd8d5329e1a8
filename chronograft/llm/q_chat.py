r"""Query ``op7_chat_format`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograft.llm import chat
from chronograft.storage import keep

PROBE = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations and the probe, written formatted and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    out = keep(chat.chat(chat.table_events(table.union(probe))), "chats")
    turns = chat.parse(F.col("formatted"))
    read = out.select("conversation", "formatted", turns.alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conversation").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


#: The length of the rendering is counted: a byte more for each character that is escaped.
SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, length(text) + length(regexp_replace(text, '[^\\#]', '', 'g')) + len(regexp_extract_all(text, '</'))
  + length(role) + length(regexp_replace(role, '[^\\# ]', '', 'g')) + len(regexp_extract_all(role, '</')) AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + length('### : </turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
