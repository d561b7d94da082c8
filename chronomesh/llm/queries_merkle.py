"""Query of the Merkle manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import merkle
from chronomesh.llm.registry import query, table


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR)::VARCHAR || ':' || {name}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if name == "n_chars" else name) for name in merkle.FIELDS) + ")"


#: Bitwise CRC-32: eight steps for each byte, the byte itself only in the first of them.
_CRC = """
xor(4294967295, list_reduce(
  list_prepend(4294967295::BIGINT, flatten(list_transform(
    generate_series(1, length(doc_id::VARCHAR)),
    lambda i: list_prepend(ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT, [0, 0, 0, 0, 0, 0, 0]::BIGINT[])))),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))))
"""

_STEP = """
  SELECT w.r, w.run, level + 1, w.pos // 2, (w.n + 1) // 2, proof || coalesce(t.node, ''),
    sha256(CASE WHEN w.pos % 2 = 0 THEN w.h || coalesce(t.node, '') ELSE t.node || w.h END)
"""

SQL = f"""
WITH RECURSIVE numbered AS (
  SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS run,
    {_leaf("n_chars")} AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS changed
  FROM documents
), leaves AS (
  SELECT r, doc_id, run, leaf, changed, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY run) AS n FROM numbered
), tree(run, tier, pos, n, node) AS (
  SELECT run, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT run, tier + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM tree WHERE n > 1
  GROUP BY run, tier, pos // 2, n
), subroots AS (
  SELECT run, node, count(*) OVER () AS n FROM tree WHERE n = 1
), above(tier, pos, n, node) AS (
  SELECT 0, run, n, node FROM subroots
  UNION ALL
  SELECT tier + 1, pos // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY tier, pos // 2, n
), walk(r, run, level, pos, n, proof, h) AS (
  SELECT r, run, 0, pos, n, '', changed FROM leaves
  UNION ALL {_STEP}
  FROM walk w LEFT JOIN tree t ON t.run = w.run AND t.tier = w.level AND t.pos = xor(w.pos, 1) WHERE w.n > 1
), climb(r, run, level, pos, n, proof, h) AS (
  SELECT w.r, w.run, 0, w.run, s.n, proof, h FROM walk w JOIN subroots s USING (run) WHERE w.n = 1
  UNION ALL {_STEP}
  FROM climb w LEFT JOIN above t ON t.tier = w.level AND t.pos = xor(w.pos, 1) WHERE w.n > 1
)
SELECT doc_id, leaf, s.node AS subroot, a.node AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = a.node AS verified
FROM leaves JOIN climb c USING (r) JOIN subroots s ON s.run = leaves.run JOIN above a ON a.n = 1 WHERE c.n = 1
"""


@query("op13_merkle_manifest", SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))
