"""Streaming jobs run to the end of the available input."""

from __future__ import annotations


from chronomesh.plans.registry import part, query
from chronomesh.sources import files, schemas, views
from chronomesh.operators.scaling import new_path
from chronomesh.streaming import jobs

W = views.CONN_BIN
#: Bins the watermark has closed at the end of the input.
part("closed", f"SELECT * FROM (SELECT *, CAST(floor(ts / {W}) * {W} AS BIGINT) AS bin_start FROM conn) WHERE bin_start + {W} <= (SELECT max(ts) - 3600 FROM conn)")


def _stream(spark, sf_dir):
    return jobs.read_conn_stream(spark, f"{sf_dir}/events.parquet")


def _run(stream, tag):
    spark = stream.sparkSession
    return jobs.run_to_table(stream, new_path(spark, tag), new_path(spark, f"{tag}-state"))


@query("stream_bin_stats", """
SELECT bin_start, count(*) AS events, CAST(sum(orig_bytes) AS BIGINT) AS orig_bytes, count(*) FILTER (label_tactic IS DISTINCT FROM 'none') AS malicious
FROM closed GROUP BY bin_start
""")
def stream_bin_stats(spark, sf_dir):
    return _run(jobs.bin_stats(_stream(spark, sf_dir), W), "bin-stats")


_FIELDS = {"hosts": ["src_ip", "dest_ip"], "service": ["service"], "label_tactic": ["label_tactic"]}


@query("stream_novelty", """
SELECT bin_start, field, count(*) AS new_values FROM (
  SELECT field, value, min(bin_start) AS bin_start FROM (
    SELECT bin_start, 'hosts' AS field, src_ip AS value FROM closed UNION ALL SELECT bin_start, 'hosts', dest_ip FROM closed
    UNION ALL SELECT bin_start, 'service', service FROM closed UNION ALL SELECT bin_start, 'label_tactic', label_tactic FROM closed)
  WHERE value IS NOT NULL GROUP BY field, value) GROUP BY bin_start, field
""")
def stream_novelty(spark, sf_dir):
    sightings = _run(jobs.value_sightings(_stream(spark, sf_dir), W, _FIELDS), "sightings")
    return jobs.novelty_from_sightings(sightings)


part("sighted", """
SELECT DISTINCT bin_start, field, value FROM (
  SELECT bin_start, 'hosts' AS field, src_ip AS value FROM closed UNION ALL SELECT bin_start, 'hosts', dest_ip FROM closed
  UNION ALL SELECT bin_start, 'service', service FROM closed UNION ALL SELECT bin_start, 'label_tactic', label_tactic FROM closed)
WHERE value IS NOT NULL
""")
part("regained", "SELECT *, lag(bin_start) OVER (PARTITION BY field, value ORDER BY bin_start) AS before FROM sighted")
EXPIRY = 6 * W


@query("stream_novelty_stateful", "SELECT bin_start, field, count(*) AS new_values FROM regained WHERE before IS NULL GROUP BY bin_start, field")
def stream_novelty_stateful(spark, sf_dir):
    """One stream with the known values in its state."""
    return _run(jobs.novelty(_stream(spark, sf_dir), W, _FIELDS), "novelty")


@query("stream_novelty_expiring", f"""
SELECT bin_start, field, count(*) AS new_values FROM regained WHERE before IS NULL OR bin_start - before > {EXPIRY} GROUP BY bin_start, field
""")
def stream_novelty_expiring(spark, sf_dir):
    """A value unseen for six bins is new again."""
    return _run(jobs.novelty(_stream(spark, sf_dir), W, _FIELDS, expiry=EXPIRY), "novelty-expiring")


@query("stream_dedup_edges", "SELECT bin_start, src_ip, dest_ip, count(*) AS copies FROM closed GROUP BY ALL")
def stream_dedup_edges(spark, sf_dir):
    return _run(jobs.dedup_edges(_stream(spark, sf_dir), W), "stream-edges")


@query("stream_redteam_label", "SELECT time, src_user, dst_user, src_computer, dst_computer, malicious FROM auth_marked")
def stream_redteam_label(spark, sf_dir):
    """The authentication log arrives as CSV files; the red-team list is static."""
    log = views.auth(spark, sf_dir)
    path = files.write_csv(log.select(*schemas.AUTH.names), new_path(spark, "auth-feed"))
    feed = spark.readStream.schema(schemas.AUTH).option("header", False).option("mode", "FAILFAST").csv(path)
    labelled = jobs.redteam_labels(feed, views.redteam(log))
    out = _run(labelled.select("time", "src_user", "dst_user", "src_computer", "dst_computer", "malicious"), "stream-labels")
    return out
