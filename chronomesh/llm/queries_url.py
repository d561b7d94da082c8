"""Query of the URL filter.

``pages`` holds neither fetch dates nor a list, so both are derived: a page is fetched on day 7 * page_id mod 360 of
2024, and the first digits of a host's MD5 decide whether and when it, or the domain above it, is listed, taken off
and listed again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.llm import url_filter
from chronomesh.llm.registry import query, table

SQL = r"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', ''), '') AS host,
    (DATE '2024-01-01' + CAST(page_id * 7 % 360 AS INTEGER))::DATE AS fetch_date FROM pages
), h AS (
  SELECT host, md5(host) AS m, ('0x' || substr(md5(host), 1, 2))::INTEGER AS day FROM (SELECT DISTINCT host FROM p WHERE host IS NOT NULL AND length(host) <= 253)
), e AS (
  SELECT CASE WHEN substr(m, 3, 1) < '8' THEN 'adult' ELSE 'malware' END AS category,
    CASE WHEN substr(m, 4, 1) < '8' OR host NOT LIKE '%.%.%.%' THEN 'host' ELSE 'domain' END AS kind,
    CASE WHEN substr(m, 4, 1) < '8' OR host NOT LIKE '%.%.%.%' THEN host ELSE substr(host, strpos(host, '.') + 1) END AS pattern,
    action, (DATE '2024-01-01' + day + later)::DATE AS date
  FROM h, (VALUES ('add', 0, '7'), ('remove', 40, '7'), ('add', 60, '3')) v(action, later, most)
  WHERE substr(m, 5, 1) <= most
), states AS (
  SELECT category, kind, pattern, date, max(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS active FROM e GROUP BY ALL
), changes AS (
  SELECT * FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY category, kind, pattern ORDER BY date), 0) AS was FROM states) WHERE active <> was
), spans AS (
  SELECT * FROM (SELECT *, lead(date) OVER (PARTITION BY category, kind, pattern ORDER BY date) AS valid_to FROM changes) WHERE active = 1
), hits AS (
  SELECT page_id, p.host, fetch_date, category FROM p JOIN spans s ON fetch_date >= s.date AND (valid_to IS NULL OR fetch_date < valid_to)
    AND (p.host = s.pattern OR (s.kind = 'domain' AND ends_with(p.host, '.' || s.pattern)))
), found AS (
  SELECT page_id, host, fetch_date, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM hits GROUP BY ALL
)
SELECT p.page_id, CASE WHEN length(p.host) <= 253 THEN p.host END AS host, p.fetch_date::VARCHAR AS fetch_date, coalesce(n, 0) AS n_entries,
  coalesce(categories, '') AS categories, coalesce(n, 0) > 0 AS blocked
FROM p LEFT JOIN found ON p.page_id = found.page_id AND p.host = found.host AND p.fetch_date = found.fetch_date
"""


def dated_list(hosts: DataFrame) -> DataFrame:
    """Entries for a table of distinct hosts."""
    digest = F.md5("host")
    one = lambda i: F.substring(digest, i, 1)
    above = (one(4) >= "8") & F.col("host").like("%.%.%.%")
    turns = F.array(*[
        F.struct(F.lit(a).alias("action"), F.lit(d).alias("later"), F.lit(m).alias("most"))
        for a, d, m in (("add", 0, "7"), ("remove", 40, "7"), ("add", 60, "3"))
    ])
    return hosts.select(
        F.when(one(3) < "8", "adult").otherwise("malware").alias("category"), F.when(above, "domain").otherwise("host").alias("kind"),
        F.when(above, F.expr("substring(host, instr(host, '.') + 1)")).otherwise(F.col("host")).alias("pattern"),
        F.conv(F.substring(digest, 1, 2), 16, 10).cast("int").alias("day"), one(5).alias("digit"), F.inline(turns),
    ).filter("digit <= most").select(
        "category", "kind", "pattern", "action", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day") + F.col("later")).alias("date"))


@query("op5_url_temporal_list", SQL)
def op5_url_temporal_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_date", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7 % 360).cast("int")))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    judged = url_filter.judge(captures, dated_list(hosts))
    return judged.withColumn("fetch_date", F.col("fetch_date").cast("string"))
