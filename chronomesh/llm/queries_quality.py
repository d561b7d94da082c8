"""Query of the quality cascade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import quality
from chronomesh.llm.registry import query, table

#: Positions of words, of lines with a word, and of repeated 8-word windows, and the thresholds of ``quality.RULES``.
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), w AS (
  SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), windows AS (
  SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (
    SELECT r, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w
  )
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, generate_series(0, 7) AS s(k) GROUP BY r
), lines AS (
  SELECT r, line, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line
), dups AS (
  SELECT r, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM lines GROUP BY r
), counts AS (
  SELECT doc_id, len(w.w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d JOIN w USING (r) LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r)
), base AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 2 * n_dup_lines > n_lines) AS kept
FROM base
"""


@query("op6_quality_cascade", SQL)
def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))
