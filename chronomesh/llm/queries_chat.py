"""Query of the preference formatter.

``conversations`` holds no pairs, so they are derived: every conversation is a chosen one, and its rejected
counterpart has in the place of its last assistant turn the last assistant turn of the
conversation with the next id (an empty reply where there is none).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm import chat
from chronomesh.llm.registry import query, table

SQL = """
WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (
  SELECT conv_id, max(turn) AS turn FROM c WHERE role = 'assistant' GROUP BY conv_id
), reply AS (
  SELECT conv_id, turn, max(text) AS text FROM c JOIN last USING (conv_id, turn) WHERE role = 'assistant' GROUP BY conv_id, turn
), r AS (
  SELECT DISTINCT c.conv_id, c.turn, c.role, CASE WHEN c.role = 'assistant' AND c.turn = own.turn THEN coalesce(donor.text, '') ELSE c.text END AS text
  FROM c LEFT JOIN reply own ON own.conv_id = c.conv_id LEFT JOIN reply donor ON donor.conv_id = c.conv_id + 1
), cn AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p FROM c
), rn AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p FROM r
), k AS (
  SELECT coalesce(cn.conv_id, rn.conv_id) AS conv_id,
    coalesce(min(coalesce(cn.p, rn.p)) FILTER (cn.p IS NULL OR rn.p IS NULL OR cn.role IS DISTINCT FROM rn.role OR cn.text IS DISTINCT FROM rn.text) - 1,
      max(cn.p), 0)::INTEGER AS k
  FROM cn FULL JOIN rn ON cn.conv_id = rn.conv_id AND cn.p = rn.p GROUP BY 1
), sides AS (
  SELECT 'c' AS side, * FROM cn UNION ALL SELECT 'r', * FROM rn
), piece AS (
  SELECT side, sides.conv_id, p, role, p <= k AS shared, k, length('<|' || coalesce(role, '') || '|>' || chr(10)) AS head,
    '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s
  FROM sides JOIN k USING (conv_id)
), placed AS (
  SELECT *, sum(length(s)) OVER (PARTITION BY side, conv_id, shared ORDER BY p) AS stop FROM piece
)
SELECT conv_id AS pair_id, max(k)::INTEGER AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY p) FILTER (side = 'c' AND shared), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY p) FILTER (side = 'c' AND NOT shared), '') AS chosen,
  coalesce(string_agg((stop - length(s) + head)::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY p)
    FILTER (side = 'c' AND NOT shared AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY p) FILTER (side = 'r' AND NOT shared), '') AS rejected,
  coalesce(string_agg((stop - length(s) + head)::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY p)
    FILTER (side = 'r' AND NOT shared AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""


def rejected_turns(turns: DataFrame) -> DataFrame:
    """Every conversation with its last assistant turn taken from the conversation with the next id."""
    reply = (
        turns.filter((F.col("role") == "assistant") & F.col("conv_id").isNotNull()).groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
        .groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last")).select("conv_id", "last.turn", "last.text")
    )
    own = reply.select("conv_id", F.col("turn").alias("last_turn"))
    donor = reply.select((F.col("conv_id") - 1).alias("conv_id"), F.col("text").alias("donor_text"))
    replaced = (F.col("role") == "assistant") & (F.col("turn") == F.col("last_turn"))
    return turns.join(own.join(donor, "conv_id", "left"), "conv_id", "left").select(
        "conv_id", "turn", "role", F.when(replaced, F.coalesce("donor_text", F.lit(""))).otherwise(F.col("text")).alias("text"),
    )


@query("op8_preference_pairs", SQL)
def op8_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat.preference_pairs(turns, rejected_turns(turns), pair_col="conv_id")
