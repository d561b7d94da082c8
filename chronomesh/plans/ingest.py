"""Scans, sinks and conversions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.operators import dims, graph, label
from chronomesh.operators.scaling import new_path
from chronomesh.plans import inputs
from chronomesh.plans.inputs import whole
from chronomesh.plans.registry import query
from chronomesh.sources import files, schemas, views

_CONN_OUT = (
    "conn_id, CAST(file_id AS BIGINT) AS file_id, round(ts, 6) AS ts, round(duration, 6) AS duration, src_ip, "
    "CAST(src_port AS BIGINT) AS src_port, dest_ip, CAST(dest_port AS BIGINT) AS dest_port, proto, service, conn_state, "
    "orig_bytes, orig_pkts, coalesce(resp_bytes, -1) AS resp_bytes, resp_pkts, missed_bytes, local_orig, local_resp, history, label_tactic"
)
_AUTH_OUT = "time, src_user, dst_user, src_computer, dst_computer, auth_type, logon_type, orientation, result"


def _conn_out(df):
    return df.selectExpr(*[c.strip() for c in (
        "conn_id", "CAST(file_id AS BIGINT) AS file_id", "round(ts, 6) AS ts", "round(duration, 6) AS duration", "src_ip",
        "CAST(src_port AS BIGINT) AS src_port", "dest_ip", "CAST(dest_port AS BIGINT) AS dest_port", "proto", "service",
        "conn_state", "orig_bytes", "orig_pkts", "coalesce(resp_bytes, -1) AS resp_bytes", "resp_pkts", "missed_bytes", "local_orig", "local_resp",
        "history", "label_tactic",
    )])


@query("scan_conn", f"SELECT {_CONN_OUT} FROM conn")
def scan_conn(spark, sf_dir):
    return _conn_out(views.conn(spark, sf_dir))


@query("scan_conn_pruned", "SELECT conn_id, src_ip, label_tactic FROM conn")
def scan_conn_pruned(spark, sf_dir):
    return views.conn(spark, sf_dir).select("conn_id", "src_ip", "label_tactic")


@query("multi_file_union", f"SELECT {_CONN_OUT} FROM conn")
def multi_file_union(spark, sf_dir):
    """Write the connections as weekly files, then read the list of files as one data set."""
    conn = views.conn(spark, sf_dir)
    base = new_path(spark, "weekly")
    files.write_parquet(conn.withColumn("week", F.col("file_id")), base, partition_by=["week"], order_by=["week", "ts"])
    return _conn_out(files.read_numbered(spark, base, "week", schemas.CONN))


def _auth_csv(spark, sf_dir) -> str:
    log = views.auth(spark, sf_dir).select(*schemas.AUTH.names)
    return files.write_csv(log, new_path(spark, "auth-csv"))


@query("scan_auth_csv", f"SELECT {_AUTH_OUT} FROM auth")
def scan_auth_csv(spark, sf_dir):
    return files.read_csv(spark, _auth_csv(spark, sf_dir), schemas.AUTH)


@query("auth_ingest_until", f"SELECT {_AUTH_OUT} FROM auth WHERE time <= 100000000")
def auth_ingest_until(spark, sf_dir):
    return files.read_csv_until(spark, _auth_csv(spark, sf_dir), schemas.AUTH, 100000000)


@query("auth_ingest_stop", f"SELECT {_AUTH_OUT} FROM auth WHERE time <= 100000000")
def auth_ingest_stop(spark, sf_dir):
    """The log comes in time-ordered parts; those that begin after the limit are not opened."""
    log = views.auth(spark, sf_dir).select(*schemas.AUTH.names).repartitionByRange(16, "time").sortWithinPartitions("time")
    path = files.write_csv(log, new_path(spark, "auth-parts"))
    return files.read_csv_ordered_until(spark, path, schemas.AUTH, 100000000)


@query("auth_csv_to_parquet", f"SELECT {_AUTH_OUT} FROM auth")
def auth_csv_to_parquet(spark, sf_dir):
    dictionaries = {
        "auth_type": schemas.AUTH_TYPE, "logon_type": schemas.LOGON_TYPE,
        "orientation": schemas.ORIENTATION, "result": schemas.RESULT,
    }
    target = new_path(spark, "auth-parquet")
    return files.csv_to_parquet(spark, _auth_csv(spark, sf_dir), target, schemas.AUTH, dictionaries, ["time"])


@query("materialize_once", "SELECT host_id, host FROM hosts")
def materialize_once(spark, sf_dir):
    """The second call finds the complete table and does not write."""
    path = new_path(spark, "hosts")
    table = inputs.hosts(spark, sf_dir)
    files.materialize_once(table, path)
    return files.materialize_once(table, path)


#: A slice of relative time with traffic in it, seconds.
SLICE = (10 * 86400, 20 * 86400)


@query("topology_slice", f"""
SELECT DISTINCT s.host_id AS source, d.host_id AS target
FROM rel JOIN hosts s ON src_ip = s.host JOIN hosts d ON dest_ip = d.host
WHERE ts > {SLICE[0]} AND ts < {SLICE[1]}
""")
def topology_slice(spark, sf_dir):
    return graph.topology_slice(inputs.relative_between(spark, sf_dir, *SLICE), inputs.hosts(spark, sf_dir), *SLICE)


@query("export_edges_json", f"""
SELECT DISTINCT concat('{{"source":', s.host_id, ',"target":', d.host_id, '}}') AS record
FROM rel JOIN hosts s ON src_ip = s.host JOIN hosts d ON dest_ip = d.host
WHERE ts > {SLICE[0]} AND ts < {SLICE[1]}
""")
def export_edges_json(spark, sf_dir):
    path = files.write_records(topology_slice(spark, sf_dir), new_path(spark, "edges-json"))
    return spark.read.text(path).withColumnRenamed("value", "record")


@query("export_hosts_json", """
SELECT concat('{"load":1,"name":"', host, '","ip":"', host, '","enabled":true,"type":4,"id":', host_id, '}') AS record FROM hosts
""")
def export_hosts_json(spark, sf_dir):
    records = inputs.hosts(spark, sf_dir).select(
        F.lit(1).alias("load"), F.col("host").alias("name"), F.col("host").alias("ip"),
        F.lit(True).alias("enabled"), F.lit(4).alias("type"), F.col("host_id").alias("id"),
    )
    path = files.write_records(records, new_path(spark, "hosts-json"))
    return spark.read.text(path).withColumnRenamed("value", "record")


@query("combined_datasets", f"""
SELECT dataset, label_tactic, count(*) AS events, count(DISTINCT src) AS sources, count(DISTINCT file_id) AS files, round(max(ts), 6) AS last_event
FROM (SELECT 'conn' AS dataset, label_tactic, src_ip AS src, concat('conn-', file_id) AS file_id, ts - {views.FIRST_EVENT} AS ts FROM conn
      UNION ALL SELECT 'auth', CASE WHEN malicious THEN 'Lateral Movement' ELSE 'none' END, src_computer,
             concat('auth-', CAST(floor(time / {views.WEEK}) AS BIGINT)), CAST(time AS DOUBLE) - (SELECT min(time) FROM auth) FROM auth_marked)
GROUP BY ALL
""")
def combined_datasets(spark, sf_dir):
    """Two data sets, each with its own first event and its own weekly files, under one label space."""
    conn, log = views.conn(spark, sf_dir), views.auth(spark, sf_dir)
    marked = label.label_redteam(log, views.redteam(log))
    parts = {
        "conn": files.DataSet(conn.select("label_tactic", F.col("src_ip").alias("src"), "ts", "file_id"), float(views.FIRST_EVENT)),
        "auth": files.DataSet(marked.select(
            F.when(F.col("malicious"), "Lateral Movement").otherwise("none").alias("label_tactic"), F.col("src_computer").alias("src"),
            F.col("time").cast("double").alias("ts"), F.floor(F.col("time") / views.WEEK).alias("file_id"),
        )),
    }
    return files.combine(parts).groupBy("dataset", "label_tactic").agg(
        F.count("*").alias("events"), F.countDistinct("src").alias("sources"), F.countDistinct("file_id").alias("files"),
        F.round(F.max("ts"), 6).alias("last_event"),
    )


@query("shuffled_dataset", """
SELECT part, count(*) AS events, min(conn_id) AS first_id, CAST(sum(conn_id) AS BIGINT) AS id_sum, round(sum(ts), 3) AS ts_sum, max(maps) AS map_rows
FROM (SELECT ntile(5) OVER (ORDER BY ts, conn_id) - 1 AS part, conn_id, ts FROM shuffled) CROSS JOIN
     (SELECT (SELECT count(*) FROM hosts) + (SELECT count(*) FROM services) AS maps) GROUP BY part
""")
def shuffled_dataset(spark, sf_dir):
    """Shuffle, cut into even parts, write the parts and both maps, and report on what was written."""
    from chronomesh.operators import split

    conn = views.conn(spark, sf_dir)
    base = new_path(spark, "shuffled")
    moved = split.random_time_shuffle(inputs.relative(spark, sf_dir), views.CONN_BIN)
    files.write_parquet(split.even_parts(moved, 5, ["ts", "conn_id"]), f"{base}/events", partition_by=["part"])
    files.write_parquet(dims.host_map(conn), f"{base}/hosts")
    files.write_parquet(dims.service_map(conn), f"{base}/services")
    maps = spark.read.parquet(f"{base}/hosts").count() + spark.read.parquet(f"{base}/services").count()
    out = spark.read.parquet(f"{base}/events").groupBy("part").agg(
        F.count("*").alias("events"), F.min("conn_id").alias("first_id"), F.sum("conn_id").alias("id_sum"),
        F.round(F.sum("ts"), 3).alias("ts_sum"), F.lit(maps).cast("bigint").alias("map_rows"),
    )
    return whole(out, "part")
