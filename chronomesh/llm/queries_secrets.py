"""Query of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronomesh.llm import secrets
from chronomesh.llm.registry import query, table


def _matches(rank: int, kind: secrets.Kind) -> str:
    pattern = "'" + kind.pattern.replace("'", "''") + "'"
    return f"""
  SELECT r, {rank} AS rank, unnest(m) AS m, unnest(v) AS v, unnest(b[1:len(m)]) AS b, unnest(range(len(m))) AS i FROM (
    SELECT r, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {kind.value}) AS v,
      regexp_split_to_array(t, {pattern}) AS b FROM d)"""


def _sql(kinds: tuple[secrets.Kind, ...]) -> str:
    base = ", ".join(str(r) for r, k in enumerate(kinds) if k.base)
    short = " ".join(f"AND NOT (rank = {r} AND length(v) < {k.least})" for r, k in enumerate(kinds) if k.least)
    names = "[" + ", ".join(f"'{k.name}'" for k in kinds) + "]"
    counts = ", ".join(f"count(*) FILTER (rank = {r}) AS n_{k.name}" for r, k in enumerate(kinds) if k.base)
    listed = ", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in kinds if k.base)
    shown = f"{names}[rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL".join(_matches(r, k) for r, k in enumerate(kinds))}
), placed AS (
  SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY r, rank ORDER BY i) AS e FROM hits
), valid AS (
  SELECT r, rank, v, (e - length(m))::BIGINT AS s, e::BIGINT AS e FROM placed WHERE true {short}
), owned AS (
  SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners FROM valid JOIN d USING (r) GROUP BY v
), classed AS (
  SELECT valid.*, CASE WHEN owners >= {secrets.EXAMPLE_OWNERS} THEN 'example'
    WHEN owners = 1 AND len(list_distinct(string_split(v, ''))) >= {secrets.LIVE_CHARACTERS}
      AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') THEN 'live' ELSE 'unclear' END AS c
  FROM valid JOIN owned USING (v)
), found AS (
  SELECT r, {counts}, count(*) FILTER (c = 'live') AS n_live, count(*) FILTER (c = 'example') AS n_example,
    string_agg({shown}) FILTER (rank IN ({base})) AS base, string_agg({shown}) AS spans
  FROM classed WHERE rank IN ({base}) OR c <> 'example' GROUP BY r
)
SELECT doc_id, {listed}, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (r)
"""


@query("op9_secret_ownership", _sql(secrets.KINDS))
def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))
