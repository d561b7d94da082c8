"""Relative time, bins, duration expansion, splits and shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.operators import split, timebin
from chronomesh.plans import inputs
from chronomesh.plans.inputs import BATCH_KEYS, shared, whole
from chronomesh.plans.parts import binned
from chronomesh.plans.registry import part, query
from chronomesh.sources import views

W, B = views.CONN_BIN, views.CONN_BATCH


@query("relative_time", "SELECT conn_id, round(ts, 6) AS ts, round(abs_ts, 6) AS abs_ts FROM rel")
def relative_time(spark, sf_dir):
    return inputs.relative(spark, sf_dir).select("conn_id", F.round("ts", 6).alias("ts"), F.round("abs_ts", 6).alias("abs_ts"))


@query("drop_nan_time", "SELECT conn_id, round(ts, 6) AS ts FROM conn WHERE duration IS NOT NULL")
def drop_nan_time(spark, sf_dir):
    """Connections without a duration get a NaN time first, so that there is something to drop."""
    broken = views.conn(spark, sf_dir).withColumn(
        "ts", F.when(F.col("duration").isNull(), F.lit(float("nan"))).otherwise(F.col("ts"))
    )
    return timebin.drop_nan_time(broken).select("conn_id", F.round("ts", 6).alias("ts"))


@query("time_range", "SELECT conn_id, round(ts, 6) AS ts FROM rel WHERE ts >= 864000 AND ts < 1728000")
def time_range(spark, sf_dir):
    """The range also goes to the scan, on the stored time, so row groups outside it are skipped."""
    lo, hi = 864000, 1728000
    rel = inputs.relative_between(spark, sf_dir, lo, hi)
    return timebin.time_range(rel, lo, hi).select("conn_id", F.round("ts", 6).alias("ts"))


@query("bin_and_batch", "SELECT conn_id, bin_abs, batch, bin FROM plain_binned")
def bin_and_batch(spark, sf_dir):
    return whole(inputs.conn_plain_binned(spark, sf_dir).select("conn_id", "bin_abs", "batch", "bin"), "bin")


@query("sequential_bins", f"""
SELECT conn_id, seq_bin, CAST(floor(seq_bin / {B}) AS BIGINT) AS seq_batch
FROM (SELECT conn_id, dense_rank() OVER (ORDER BY floor(ts / 600)) - 1 AS seq_bin FROM rel)
""")
def sequential_bins(spark, sf_dir):
    """Ten-minute bins, many of them empty, renumbered without gaps."""
    rel = inputs.relative(spark, sf_dir).withColumn("bin10", F.floor(F.col("ts") / 600))
    return timebin.sequential_bins(rel, "bin10", B).select("conn_id", "seq_bin", "seq_batch")


@query("dense_bins", f"""
SELECT s.batch, s.bin, count(conn_id) AS events
FROM (SELECT batch, CAST(unnest(range(288)) AS BIGINT) AS bin FROM (SELECT DISTINCT batch FROM fine)) s
LEFT JOIN fine USING (batch, bin) GROUP BY ALL
""")
def dense_bins(spark, sf_dir):
    """Ten-minute bins, 288 to a batch; empty bins have zero events."""
    fine = timebin.bin_events(inputs.relative(spark, sf_dir), "ts", 600, 288)
    counts = fine.groupBy("batch", "bin").agg(F.count("*").alias("events"))
    spine = timebin.bin_spine(fine, ["batch"], 288)
    return whole(spine.join(counts, ["batch", "bin"], "left").na.fill(0, ["events"]), "bin")


part("fine", binned("rel", "ts", 600, 288))


@query("expand_duration", "SELECT conn_id, piece, round(ts, 6) AS ts, conn_status, status_code FROM expanded")
def expand_duration(spark, sf_dir):
    out = inputs.expanded(inputs.relative(spark, sf_dir))
    return whole(out.select("conn_id", "piece", F.round("ts", 6).alias("ts"), "conn_status", "status_code"), "status_code")


@query("expand_duration_off", "SELECT conn_id, CAST(0 AS BIGINT) AS piece, round(ts, 6) AS ts, 'closing' AS conn_status, CAST(2 AS BIGINT) AS status_code FROM rel")
def expand_duration_off(spark, sf_dir):
    out = timebin.without_duration(inputs.relative(spark, sf_dir))
    return whole(out.select("conn_id", "piece", F.round("ts", 6).alias("ts"), "conn_status", "status_code"), "status_code")


@query("expand_time_range", "SELECT conn_id, piece, round(ts, 6) AS ts, conn_status FROM expanded WHERE ts >= 864000 AND ts < 1728000")
def expand_time_range(spark, sf_dir):
    """Expanded pieces of ten days; the longest connection bounds how far past the range to read."""
    lo, hi = 864000, 1728000
    longest = views.conn(spark, sf_dir).agg(F.max("duration")).first()[0] or 0.0
    out = timebin.expand_range(inputs.relative_between(spark, sf_dir, lo, hi + longest), lo, hi, W, longest)
    return out.select("conn_id", "piece", F.round("ts", 6).alias("ts"), "conn_status")


@query("batch_split", "SELECT CAST(file_id AS BIGINT) AS file_id, batch, CAST(stage AS BIGINT) AS stage FROM conn_split")
def batch_split(spark, sf_dir):
    return whole(inputs.conn_split(inputs.conn_binned(spark, sf_dir)), "file_id", "stage")


@query("auth_batch_split", "SELECT batch, CAST(stage AS BIGINT) AS stage FROM auth_split")
def auth_batch_split(spark, sf_dir):
    return whole(inputs.auth_split(inputs.auth_binned(spark, sf_dir)), "stage")


@query("split_sizes", "SELECT CAST(stage AS BIGINT) AS stage, count(*) AS batches FROM conn_split GROUP BY stage")
def split_sizes(spark, sf_dir):
    return whole(split.split_sizes(inputs.conn_split(inputs.conn_binned(spark, sf_dir))), "stage")


@query("stage_events", """
SELECT CAST(file_id AS BIGINT) AS file_id, batch, bin, conn_id, piece, CAST(stage AS BIGINT) AS stage
FROM binned JOIN conn_split USING (file_id, batch) WHERE stage = 1
""")
def stage_events(spark, sf_dir):
    events = shared(inputs.conn_binned(spark, sf_dir).select(*BATCH_KEYS, "bin", "conn_id", "piece"), "binned")
    picked = split.stage_events(events, inputs.conn_split(events), BATCH_KEYS, 1)
    return whole(picked.select("file_id", "batch", "bin", "conn_id", "piece", "stage"), "file_id", "bin", "stage")


part("shuffled", f"""
SELECT t.conn_id, t.ts - t.b * {W} + g.b * {W} AS ts
FROM (SELECT conn_id, ts, floor(ts / {W}) AS b, row_number() OVER (ORDER BY md5(concat('42:', conn_id))) AS r FROM rel) t
JOIN (SELECT floor(ts / {W}) AS b, row_number() OVER (ORDER BY md5(concat('43:', conn_id))) AS r FROM rel) g USING (r)
""")


@query("random_time_shuffle", "SELECT conn_id, round(ts, 6) AS ts FROM shuffled")
def random_time_shuffle(spark, sf_dir):
    moved = split.random_time_shuffle(inputs.relative(spark, sf_dir).select("conn_id", "ts"), W)
    return moved.select("conn_id", F.round("ts", 6).alias("ts"))


@query("random_time_shuffle_widths", f"""
SELECT width, label_tactic, count(*) AS events, count(DISTINCT floor(nts / {W})) AS bins, round(sum(nts), 3) AS ts_sum
FROM (SELECT t.width, t.label_tactic, t.ts - t.b * t.width + g.b * t.width AS nts
      FROM (SELECT width, label_tactic, ts, floor(ts / width) AS b, row_number() OVER (PARTITION BY width ORDER BY md5(concat('42:', conn_id))) AS r FROM rel, (SELECT unnest([0.5::DOUBLE, 5.0::DOUBLE, 400.0::DOUBLE]) AS width)) t
      JOIN (SELECT width, floor(ts / width) AS b, row_number() OVER (PARTITION BY width ORDER BY md5(concat('43:', conn_id))) AS r FROM rel, (SELECT unnest([0.5::DOUBLE, 5.0::DOUBLE, 400.0::DOUBLE]) AS width)) g USING (width, r))
GROUP BY width, label_tactic
""")
def random_time_shuffle_widths(spark, sf_dir):
    """Three widths side by side: how the classes spread over hourly bins afterwards."""
    rel = inputs.relative(spark, sf_dir).select("conn_id", "ts", "label_tactic")
    orders = split.shuffle_orders(rel)
    variants = [split.swap_bins(orders, w).withColumn("width", F.lit(w)) for w in (0.5, 5.0, 400.0)]
    moved = variants[0].unionByName(variants[1]).unionByName(variants[2])
    return moved.groupBy("width", "label_tactic").agg(
        F.count("*").alias("events"), F.countDistinct(F.floor(F.col("ts") / W)).alias("bins"), F.round(F.sum("ts"), 3).alias("ts_sum")
    )


@query("bin_permutation_shuffle", f"""
SELECT conn_id, round(ts - b * {W} + nb * {W}, 6) AS ts
FROM (SELECT conn_id, ts, CAST(floor(ts / {W}) AS BIGINT) AS b FROM rel) JOIN (
  SELECT t.b, g.b AS nb
  FROM (SELECT b, row_number() OVER (ORDER BY md5(concat('42:', b))) AS r FROM (SELECT DISTINCT CAST(floor(ts / {W}) AS BIGINT) AS b FROM rel)) t
  JOIN (SELECT b, row_number() OVER (ORDER BY md5(concat('43:', b))) AS r FROM (SELECT DISTINCT CAST(floor(ts / {W}) AS BIGINT) AS b FROM rel)) g USING (r)) USING (b)
""")
def bin_permutation_shuffle(spark, sf_dir):
    moved = split.bin_permutation_shuffle(inputs.relative(spark, sf_dir).select("conn_id", "ts"), W)
    return moved.select("conn_id", F.round("ts", 6).alias("ts"))


@query("day_fold", "SELECT conn_id, CAST(floor(es) - floor(es / 86400) * 86400 AS BIGINT) AS ts FROM (SELECT conn_id, ts AS es FROM conn)")
def day_fold(spark, sf_dir):
    return timebin.day_fold(views.conn(spark, sf_dir)).select("conn_id", "ts")


@query("day_fold_bins", f"""
SELECT batch, bin, count(*) AS events, min(conn_id) AS first_id FROM folded GROUP BY ALL
""")
def day_fold_bins(spark, sf_dir):
    folded = timebin.day_fold(views.conn(spark, sf_dir).select("conn_id", "datetime"))
    out = timebin.bin_events(folded, "ts", 20, 350)
    return whole(out.groupBy("batch", "bin").agg(F.count("*").alias("events"), F.min("conn_id").alias("first_id")), "bin")


part("folded", binned("(SELECT conn_id, CAST(floor(ts) - floor(ts / 86400) * 86400 AS BIGINT) AS ts FROM conn)", "ts", 20, 350))


@query("even_parts", "SELECT conn_id, ntile(7) OVER (ORDER BY ts, conn_id) - 1 AS part FROM conn")
def even_parts(spark, sf_dir):
    out = split.even_parts(views.conn(spark, sf_dir).select("conn_id", "ts"), 7, ["ts", "conn_id"])
    return whole(out.select("conn_id", "part"), "part")


@query("time_sorted", "SELECT conn_id, piece, round(ts, 6) AS ts FROM expanded ORDER BY ts, conn_id, piece")
def time_sorted(spark, sf_dir):
    out = inputs.expanded(inputs.relative(spark, sf_dir)).orderBy("ts", "conn_id", "piece")
    return out.select("conn_id", "piece", F.round("ts", 6).alias("ts"))
