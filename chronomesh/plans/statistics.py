"""Counts, summaries, novelty and class distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.operators import label, stats, timebin
from chronomesh.plans import inputs
from chronomesh.plans.inputs import BATCH_KEYS, KEYS, shared, whole
from chronomesh.plans.registry import part, query
from chronomesh.sources import schemas, views

W, B = views.CONN_BIN, views.CONN_BATCH
LABELS = schemas.LABEL_TACTIC


def quoted(name: str) -> str:
    return '"' + name + '"'


@query("distinct_edges", "SELECT DISTINCT src_ip, dest_ip FROM conn")
def distinct_edges(spark, sf_dir):
    return views.conn(spark, sf_dir).select("src_ip", "dest_ip").distinct()


@query("dataset_summary", """
SELECT CAST(file_id AS BIGINT) AS file_id, round(min(ts), 6) AS first_event, round(max(ts), 6) AS last_event,
       round(max(ts) - min(ts), 6) AS length, count(*) AS events, max(h.unique_hosts) AS unique_hosts
FROM conn JOIN (SELECT file_id, count(DISTINCT host) AS unique_hosts FROM
     (SELECT file_id, coalesce(src_ip, 'None') AS host FROM conn UNION ALL SELECT file_id, coalesce(dest_ip, 'None') FROM conn) GROUP BY file_id) h USING (file_id)
GROUP BY file_id
""")
def dataset_summary(spark, sf_dir):
    out = stats.dataset_summary(views.conn(spark, sf_dir), "file_id", "ts", ["src_ip", "dest_ip"])
    times = {c: F.round(c, 6) for c in ("first_event", "last_event", "length")}
    return whole(out.withColumns(times), "file_id")


@query("auth_summary", """
SELECT 'auth' AS dataset, min(time) AS first_event, max(time) AS last_event, max(time) - min(time) AS length,
       count(*) AS events, (SELECT count(*) FROM auth_hosts) AS unique_hosts FROM auth
""")
def auth_summary(spark, sf_dir):
    log = views.auth(spark, sf_dir).withColumn("dataset", F.lit("auth"))
    return stats.dataset_summary(log, "dataset", "time", ["src_computer", "dst_computer"])


@query("event_count", "SELECT count(*) AS events FROM expanded")
def event_count(spark, sf_dir):
    return inputs.expanded(inputs.relative(spark, sf_dir)).agg(F.count("*").alias("events"))


_COUNTS = "SELECT batch, label_tactic, count(*) AS events FROM plain_binned GROUP BY ALL"
part("label_count_t", _COUNTS)


def _label_counts(spark, sf_dir):
    return stats.label_counts(inputs.conn_plain_binned(spark, sf_dir), ["batch"], "label_tactic")


@query("label_counts", _COUNTS)
def label_counts(spark, sf_dir):
    return _label_counts(spark, sf_dir)


@query("label_counts_tail", "SELECT * FROM label_count_t WHERE batch > 10")
def label_counts_tail(spark, sf_dir):
    """The bound on the batch is also one on the stored time, which reaches the scan."""
    late = inputs.relative_between(spark, sf_dir, 11 * B * W, None)
    return stats.label_counts(timebin.bin_events(late, "ts", W, B).filter("batch > 10"), ["batch"], "label_tactic")


_OTHER_SQL = f"coalesce(sum(CASE WHEN label_tactic IS NULL OR label_tactic NOT IN ({', '.join(repr(v) for v in LABELS)}) THEN events END), 0)"


@query("label_pivot", "SELECT batch, " + ", ".join(
    f"CAST(coalesce(sum(CASE WHEN label_tactic = '{v}' THEN events END), 0) AS BIGINT) AS {quoted(v)}" for v in LABELS
) + f", CAST({_OTHER_SQL} AS BIGINT) AS other FROM label_count_t GROUP BY batch ORDER BY batch")
def label_pivot(spark, sf_dir):
    return stats.label_pivot(_label_counts(spark, sf_dir), "batch", "label_tactic", LABELS).orderBy("batch")


@query("label_cumulative", "SELECT batch, " + ", ".join(
    f"CAST(sum({quoted(v)}) OVER (ORDER BY batch) AS BIGINT) AS {quoted(v)}" for v in [*LABELS, "other"]
) + " FROM (SELECT batch, " + ", ".join(
    f"coalesce(sum(CASE WHEN label_tactic = '{v}' THEN events END), 0) AS {quoted(v)}" for v in LABELS
) + f", {_OTHER_SQL} AS other FROM label_count_t GROUP BY batch)")
def label_cumulative(spark, sf_dir):
    totals = stats.label_cumulative(_label_counts(spark, sf_dir), "batch", "label_tactic", LABELS)
    wide = totals.select("batch", "label_tactic", F.col("cumulative").alias("events"))
    return stats.label_pivot(wide, "batch", "label_tactic", LABELS)


@query("label_pivot_all_classes", """
SELECT batch, CAST(sum(events) FILTER (label_tactic = 'none') AS BIGINT) AS none, CAST(sum(events) FILTER (label_tactic = 'Discovery') AS BIGINT) AS "Discovery",
       CAST(coalesce(sum(events) FILTER (label_tactic IS NULL OR label_tactic NOT IN ('none', 'Discovery')), 0) AS BIGINT) AS other
FROM (SELECT batch, CASE WHEN conn_id % 10 = 0 THEN NULL ELSE label_tactic END AS label_tactic, count(*) AS events FROM plain_binned GROUP BY ALL)
GROUP BY batch
""")
def label_pivot_all_classes(spark, sf_dir):
    """Every tenth event has no class, and two classes are listed: each row still adds up to its events."""
    events = inputs.conn_plain_binned(spark, sf_dir).withColumn(
        "label_tactic", F.when(F.col("conn_id") % 10 != 0, F.col("label_tactic")))
    return stats.label_pivot(stats.label_counts(events, ["batch"], "label_tactic"), "batch", "label_tactic", ["none", "Discovery"])


@query("label_totals", "SELECT label_tactic, count(*) AS events FROM conn GROUP BY label_tactic")
def label_totals(spark, sf_dir):
    return stats.label_counts(views.conn(spark, sf_dir), [], "label_tactic")


@query("bucket_counts", "SELECT CAST(floor(ts / 20) AS BIGINT) AS bucket, count(*) AS events FROM folded_plain GROUP BY bucket ORDER BY events DESC, bucket")
def bucket_counts(spark, sf_dir):
    from chronomesh.operators.timebin import day_fold

    return stats.bucket_counts(day_fold(views.conn(spark, sf_dir).select("conn_id", "datetime")), "ts", 20)


part("folded_plain", "SELECT conn_id, CAST(floor(ts) - floor(ts / 86400) * 86400 AS BIGINT) AS ts FROM conn")

NOVEL_COLUMNS = [
    "conn_status", "proto", "service", "conn_state", "label_tactic", "src_port", "dest_port", "duration",
    "orig_bytes", "orig_pkts", "resp_bytes", "resp_pkts", "missed_bytes", "local_orig", "local_resp", "history",
]
NOVEL_PAIRS = {"hosts": [["src_ip"], ["dest_ip"]], "services": [["src_ip", "src_port"], ["dest_ip", "dest_port"]]}
NOVEL_FIELDS = [*NOVEL_COLUMNS, *NOVEL_PAIRS]
_CELLS = ", ".join(
    [f"{{'field': '{c}', 'value': CAST({c} AS VARCHAR)}}" for c in NOVEL_COLUMNS]
    + ["{'field': 'hosts', 'value': src_ip}", "{'field': 'hosts', 'value': dest_ip}",
       "{'field': 'services', 'value': concat(src_ip, '|', src_port)}", "{'field': 'services', 'value': concat(dest_ip, '|', dest_port)}"]
)
part("first_at", f"""
SELECT c.field, c.value, min(seen_at) AS seen_at FROM (SELECT {{'file_id': file_id, 'batch': batch, 'bin': bin}} AS seen_at, unnest([{_CELLS}]) AS c FROM binned)
WHERE c.value IS NOT NULL GROUP BY c.field, c.value
""")
part("novel", "SELECT file_id, batch, bin, " + ", ".join(
    f"coalesce(max(CASE WHEN field = '{f}' THEN n END), 0) AS new_{f}" for f in NOVEL_FIELDS
) + """ FROM spine LEFT JOIN (SELECT seen_at.file_id AS file_id, seen_at.batch AS batch, seen_at.bin AS bin, field, count(*) AS n FROM first_at GROUP BY ALL) USING (file_id, batch, bin)
GROUP BY file_id, batch, bin""")
_KEYS_SQL = "CAST(file_id AS BIGINT) AS file_id, batch, bin"


def _novelty(spark, sf_dir):
    ends = [c for pair in NOVEL_PAIRS.values() for end in pair for c in end]
    columns = list(dict.fromkeys([*KEYS, *NOVEL_COLUMNS, *ends]))
    return stats.novelty(shared(inputs.conn_binned(spark, sf_dir).select(*columns), "binned"), BATCH_KEYS, B, NOVEL_COLUMNS, NOVEL_PAIRS)


@query("novelty_per_bin", f"SELECT {_KEYS_SQL}, " + ", ".join(f"new_{f}" for f in NOVEL_FIELDS) + " FROM novel")
def novelty_per_bin(spark, sf_dir):
    return whole(_novelty(spark, sf_dir), "file_id", "bin")


part("auth_first", """
SELECT c.f AS field, c.v AS value, min(seen_at) AS seen_at FROM (
  SELECT {'batch': batch, 'bin': bin} AS seen_at, unnest([{'f': 'auth_type', 'v': auth_type}, {'f': 'logon_type', 'v': logon_type},
    {'f': 'orientation', 'v': orientation}, {'f': 'result', 'v': result}, {'f': 'hosts', 'v': src_computer}, {'f': 'hosts', 'v': dst_computer},
    {'f': 'users', 'v': src_user}, {'f': 'users', 'v': dst_user}]) AS c FROM auth_binned) GROUP BY c.f, c.v
""")
AUTH_NOVEL = ["auth_type", "logon_type", "orientation", "result", "hosts", "users"]


@query("auth_novelty_per_bin", "SELECT s.batch, s.bin, " + ", ".join(
    f"count(CASE WHEN field = '{f}' THEN 1 END) AS new_{f}" for f in AUTH_NOVEL
) + f""" FROM (SELECT batch, CAST(unnest(range({views.AUTH_BATCH})) AS BIGINT) AS bin FROM (SELECT DISTINCT batch FROM auth_binned)) s
LEFT JOIN (SELECT seen_at.batch AS batch, seen_at.bin AS bin, field FROM auth_first) f ON s.batch = f.batch AND s.bin = f.bin GROUP BY s.batch, s.bin""")
def auth_novelty_per_bin(spark, sf_dir):
    pairs = {"hosts": [["src_computer"], ["dst_computer"]], "users": [["src_user"], ["dst_user"]]}
    out = stats.novelty(inputs.auth_binned(spark, sf_dir), ["batch"], views.AUTH_BATCH, AUTH_NOVEL[:4], pairs)
    return whole(out, "bin")


_CURVE = ["hosts", "services"]


@query("novelty_cumulative", f"""
SELECT {_KEYS_SQL}, CAST(sum(new_hosts) OVER w AS BIGINT) AS seen_hosts, CAST(sum(new_services) OVER w AS BIGINT) AS seen_services
FROM novel WINDOW w AS (ORDER BY file_id, batch, bin)
""")
def novelty_cumulative(spark, sf_dir):
    novel = stats.novelty(_ends(spark, sf_dir), BATCH_KEYS, B, [], NOVEL_PAIRS)
    return whole(stats.novelty_cumulative(novel, KEYS, _CURVE).select(*KEYS, "seen_hosts", "seen_services"), "file_id", "bin")


part("novel_staged", """
SELECT CAST(stage AS BIGINT) AS stage, CAST(file_id AS BIGINT) AS file_id, batch, bin, row_number() OVER w - 1 AS position,
       CAST(sum(new_hosts) OVER w AS BIGINT) AS seen_hosts, CAST(sum(new_services) OVER w AS BIGINT) AS seen_services
FROM novel JOIN conn_split USING (file_id, batch) WINDOW w AS (ORDER BY stage, file_id, batch, bin)
""")


def _ends(spark, sf_dir):
    """The binned events with what novelty curves read of them, expanded and written once."""
    return shared(inputs.conn_binned(spark, sf_dir).select(*KEYS, "src_ip", "src_port", "dest_ip", "dest_port"), "binned-ends")


def _curve(spark, sf_dir):
    events = _ends(spark, sf_dir)
    novel = stats.novelty(events, BATCH_KEYS, B, [], NOVEL_PAIRS).join(inputs.conn_split(events), BATCH_KEYS)
    return stats.novelty_by_stage(novel, KEYS, _CURVE)


@query("novelty_by_stage", "SELECT * FROM novel_staged ORDER BY position")
def novelty_by_stage(spark, sf_dir):
    out = _curve(spark, sf_dir).select("stage", *KEYS, "position", "seen_hosts", "seen_services")
    return whole(out, "stage", "file_id", "bin").orderBy("position")


@query("novelty_stage_ranges", """
SELECT stage, min(position) AS x_start, max(position) AS x_end,
       CASE stage WHEN 1 THEN 'Validation' WHEN 2 THEN 'Testing' ELSE 'Training' END AS stage_name FROM novel_staged GROUP BY stage
""")
def novelty_stage_ranges(spark, sf_dir):
    return whole(stats.stage_ranges(_curve(spark, sf_dir)), "stage")


@query("dataset_stats", """
SELECT (SELECT count(*) FROM expanded) AS event_count, CAST(sum(new_hosts) AS BIGINT) AS unique_hosts,
       CAST(sum(new_services) AS BIGINT) AS unique_services, max(new_hosts) AS max_new_hosts, max(new_services) AS max_new_services
FROM novel
""")
def dataset_stats(spark, sf_dir):
    """True totals, and next to them the largest number of new values in one bin."""
    events = _ends(spark, sf_dir)
    counts = events.groupBy(*KEYS).agg(F.count("*").alias("_n"))
    novel = stats.novelty(events, BATCH_KEYS, B, [], NOVEL_PAIRS).join(counts, KEYS, "left")
    return novel.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("event_count"),
        F.sum("new_hosts").alias("unique_hosts"), F.sum("new_services").alias("unique_services"),
        F.max("new_hosts").alias("max_new_hosts"), F.max("new_services").alias("max_new_services"),
    )


part("marked_bins", "SELECT label_tactic IS DISTINCT FROM 'none' AS mal, bin_abs, batch FROM plain_binned")


@query("class_time_quartiles", """
SELECT mal, count(*) AS events, quantile_cont(bin_abs, 0.25) AS q1, quantile_cont(bin_abs, 0.5) AS median, quantile_cont(bin_abs, 0.75) AS q3
FROM marked_bins GROUP BY mal
""")
def class_time_quartiles(spark, sf_dir):
    return stats.time_quartiles(label.malicious_flag(inputs.conn_plain_binned(spark, sf_dir)), ["mal"], "bin_abs")


part("density_counts", "SELECT mal, bin_abs::DOUBLE AS v, count(*) AS n FROM marked_bins GROUP BY ALL")
part("density_widths", """
SELECT mal, count(*) AS total, greatest(0.9::DOUBLE * CASE WHEN q3 > q1 THEN least(dev, (q3 - q1) / 1.34::DOUBLE) ELSE dev END * pow(count(*), -0.2::DOUBLE), 0.5::DOUBLE) AS h
FROM marked_bins JOIN (SELECT mal, quantile_cont(bin_abs, 0.25) AS q1, quantile_cont(bin_abs, 0.75) AS q3, stddev_pop(bin_abs) AS dev FROM marked_bins GROUP BY mal) USING (mal)
GROUP BY mal, q1, q3, dev
""")
part("density_points", """
SELECT mal, v, n, total, k, exp(-pow((k - v) / h, 2) / 2) AS w FROM (
  SELECT *, unnest(generate_series(CAST(ceil(v - 4 * h) AS BIGINT), CAST(floor(v + 4 * h) AS BIGINT))) AS k FROM density_counts JOIN density_widths USING (mal))
""")


@query("class_time_density", """
SELECT mal, k::DOUBLE AS point, round(sum(n * w / given / total), 9) AS density
FROM (SELECT *, sum(w) OVER (PARTITION BY mal, v) AS given FROM density_points) GROUP BY mal, k
""")
def class_time_density(spark, sf_dir):
    """How events of both kinds spread over the bins; the densities of a kind add up to 1."""
    marked = label.malicious_flag(inputs.conn_plain_binned(spark, sf_dir))
    return stats.time_density(marked, ["mal"], "bin_abs").withColumn("density", F.round("density", 9))


@query("auth_time_quartiles", """
SELECT malicious, count(*) AS events, quantile_cont(bin_abs, 0.25) AS q1, quantile_cont(bin_abs, 0.5) AS median, quantile_cont(bin_abs, 0.75) AS q3
FROM auth_marked GROUP BY malicious
""")
def auth_time_quartiles(spark, sf_dir):
    log = inputs.auth_binned(spark, sf_dir)
    marked = label.label_redteam(log, views.redteam(views.auth(spark, sf_dir)))
    return stats.time_quartiles(marked, ["malicious"], "bin_abs")


@query("class_time_histogram", "SELECT mal, CAST(floor(bin_abs / 24) AS BIGINT) AS bucket, count(*) AS events FROM marked_bins GROUP BY ALL")
def class_time_histogram(spark, sf_dir):
    return stats.time_histogram(label.malicious_flag(inputs.conn_plain_binned(spark, sf_dir)), ["mal"], "bin_abs", 24)


part("balance", f"""
SELECT file_id, batch, count(*) FILTER (y > 0) AS malicious, count(*) FILTER (y <= 0) AS benign,
       count(*) FILTER (bin >= {views.WINDOW}) AS scored, count(*) FILTER (bin >= {views.WINDOW} AND y > 0) AS scored_malicious
FROM edges GROUP BY file_id, batch
""")


@query("class_balance", """
SELECT CAST(file_id AS BIGINT) AS file_id, batch, malicious, benign, scored, scored_malicious,
       CASE WHEN scored > 0 THEN round(greatest(scored_malicious / scored, 0.2), 6) END AS share FROM balance
""")
def class_balance(spark, sf_dir):
    from chronomesh.operators.graph import conn_codes

    events = inputs.binned(conn_codes(inputs.relative(spark, sf_dir)))
    out = stats.class_balance(events, BATCH_KEYS, "y", views.WINDOW)
    return whole(out.withColumn("share", F.round("share", 6)), "file_id")


@query("running_mean_metric", """
SELECT CAST(stage AS BIGINT) AS stage, batch, round(share, 6) AS share,
       round(avg(share) OVER (PARTITION BY stage ORDER BY batch), 6) AS mean_share
FROM (SELECT stage, batch, count(*) FILTER (label_tactic IS DISTINCT FROM 'none') / count(*) AS share FROM binned JOIN conn_split USING (file_id, batch) GROUP BY stage, batch)
""")
def running_mean_metric(spark, sf_dir):
    """Malicious share per batch as the step metric, averaged over the steps of its stage so far."""
    events = inputs.conn_binned(spark, sf_dir)
    per_batch = events.groupBy(*BATCH_KEYS).agg(
        F.count_if(label.is_malicious()).alias("_bad"), F.count("*").alias("_all")
    )
    per_batch = shared(per_batch, "per-batch")
    steps = per_batch.join(inputs.conn_split(per_batch), BATCH_KEYS).groupBy("stage", "batch").agg(
        (F.sum("_bad") / F.sum("_all")).alias("share")
    )
    out = stats.running_mean(steps, ["stage"], "batch", "share")
    return whole(out.select("stage", "batch", F.round("share", 6).alias("share"), F.round("mean_share", 6).alias("mean_share")), "stage")
