"""Connection, authentication and related views over the given tables.

The column expressions are plain SQL that reads the same in every engine; only the JSON
field and the epoch are spelled per engine, so each view names them as ``k`` and ``es``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.functions.scalar import epoch_micros, epoch_seconds
from chronomesh.sources import schemas

#: Time of the first connection, epoch seconds.
FIRST_EVENT = 1704067200
#: Length of one weekly connection file, seconds.
WEEK = 604800
#: Bin width in seconds and bins per batch for the connection log.
CONN_BIN, CONN_BATCH = 3600, 48
#: The same for the authentication log.
AUTH_BIN, AUTH_BATCH = 86400, 60
#: Bins a model looks back on.
WINDOW = 30

CONN_COLUMNS = {
    "conn_id": "event_id",
    "file_id": f"CAST(floor((es - {FIRST_EVENT}) / {WEEK}) AS INT)",
    "ts": "es",
    "datetime": "ts",
    "duration": "CASE WHEN event_id % 10 = 0 THEN NULL ELSE value * 100 END",
    "src_ip": "concat('10.0.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS STRING), '.', CAST(user_id % 256 AS STRING))",
    "src_port": "CAST(1024 + user_id % 7 AS INT)",
    "dest_ip": (
        "CASE WHEN k = 50 THEN concat('10.0.', CAST(CAST(floor(user_id / 256) AS BIGINT) AS STRING), '.', CAST(user_id % 256 AS STRING))"
        " WHEN k % 6 = 0 THEN concat('192.168.1.', CAST(k AS STRING))"
        " WHEN k % 6 = 1 THEN concat('8.8.4.', CAST(k AS STRING))"
        " WHEN k % 6 = 2 THEN concat('224.0.0.', CAST(k AS STRING))"
        " WHEN k % 6 = 3 THEN '255.255.255.255'"
        " WHEN k % 6 = 4 THEN concat('host-', CAST(k AS STRING))"
        " ELSE concat('fe80::', CAST(k AS STRING)) END"
    ),
    "dest_port": "CAST(k * 29 % 2000 AS INT)",
    "proto": "CASE event_id % 3 WHEN 0 THEN 'icmp' WHEN 1 THEN 'udp' ELSE 'tcp' END",
    "service": (
        "CASE WHEN k % 11 = 0 THEN NULL ELSE CASE k % 5 WHEN 0 THEN 'dns' WHEN 1 THEN 'http'"
        " WHEN 2 THEN 'ssl' WHEN 3 THEN 'smb' ELSE 'ssh' END END"
    ),
    "conn_state": "CASE event_id % 4 WHEN 0 THEN 'SF' WHEN 1 THEN 'S0' WHEN 2 THEN 'REJ' ELSE 'RSTO' END",
    "orig_bytes": "CAST(floor(value * 1000) AS BIGINT)",
    "orig_pkts": "event_id % 50",
    "resp_bytes": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(floor(value * 700) AS BIGINT) END",
    "resp_pkts": "event_id % 40",
    "missed_bytes": "CAST(0 AS BIGINT)",
    "local_orig": "user_id % 2 = 0",
    "local_resp": "k % 2 = 0",
    "history": "CAST(NULL AS STRING)",
    "label_tactic": (
        "CASE WHEN event_type <> 'error' THEN 'none' ELSE CASE k % 3 WHEN 0 THEN 'Reconnaissance'"
        " WHEN 1 THEN 'Discovery' ELSE 'Credential Access' END END"
    ),
}

AUTH_COLUMNS = {
    "auth_id": "o_orderkey",
    "time": "es - 788918400 + o_orderkey % 86400",
    "src_user": "concat('U', CAST(o_custkey AS STRING), '@DOM', CAST(c_nationkey % 3 AS STRING))",
    "dst_user": "concat('U', CAST(o_custkey * 7 % 1500 AS STRING), '@DOM1')",
    "src_computer": "concat('C', CAST(c_nationkey AS STRING))",
    "dst_computer": "concat('C', CAST(o_custkey % 40 AS STRING))",
    "auth_type": "CASE o_orderkey % 3 WHEN 0 THEN 'Kerberos' WHEN 1 THEN 'NTLM' ELSE 'Negotiate' END",
    "logon_type": "CASE o_orderkey % 4 WHEN 0 THEN 'Network' WHEN 1 THEN 'Service' WHEN 2 THEN 'Batch' ELSE '?' END",
    "orientation": "CASE o_orderkey % 3 WHEN 0 THEN 'LogOn' WHEN 1 THEN 'LogOff' ELSE 'TGS' END",
    "result": "CASE WHEN o_orderstatus = 'F' THEN 'Fail' ELSE 'Success' END",
}


def _exprs(columns: dict[str, str]) -> list[str]:
    return [f"{text} AS {name}" for name, text in columns.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name == "events":
        reader = reader.schema(schemas.EVENTS)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def conn_from_events(events: DataFrame) -> DataFrame:
    """Connection log over an events frame, batch or streaming."""
    return events.withColumns({
        "k": F.get_json_object("props", "$.k").cast("int"),
        "es": epoch_micros(F.col("ts")) / F.lit(1e6),
    }).selectExpr(*_exprs(CONN_COLUMNS))


def conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conn_from_events(table(spark, sf_dir, "events"))


def auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    # `customer` grows with the data, so no broadcast hint: Spark picks by measured size.
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    return joined.withColumn("es", epoch_seconds(F.col("o_orderdate"))).selectExpr(*_exprs(AUTH_COLUMNS))


def redteam(auth_log: DataFrame) -> DataFrame:
    """Red-team list: some rows name the source user, some the target user, some repeat."""
    keys = F.expr(
        "concat("
        "if(auth_id % 50 = 0, array(src_user), cast(array() as array<string>)),"
        "if(auth_id % 75 = 0, array(dst_user), cast(array() as array<string>)),"
        "if(auth_id % 100 = 0, array(src_user), cast(array() as array<string>)))"
    )
    return (
        auth_log.filter("auth_id % 25 = 0")
        .select("time", F.explode(keys).alias("user_name"), "src_computer", "dst_computer")
    )


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label"
    )


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored rows for the binary metrics."""
    labels = table(spark, sf_dir, "labels")
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = F.round(F.expr("1 / (1 + exp(-(n_chars % 100 - 50) / 10.0D))"), 6)
    return labels.join(documents, "doc_id").select(
        (F.col("doc_id") % 8).cast("int").alias("batch"),
        "doc_id",
        F.expr("cast((n_chars % 100 - 50) / 10.0D as double)").alias("logit"),
        score.alias("score"),
        F.col("quality").alias("label"),
        F.col("toxic").alias("malicious"),
    )


def class_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiclass predictions: the first ten vector elements are logits for ten classes."""
    return emb(spark, sf_dir).select(
        (F.col("vec_id") % 4).cast("int").alias("batch"),
        F.col("vec_id").alias("edge_id"),
        F.slice("embedding", 1, 10).alias("logits"),
        "label",
        F.element_at("embedding", 11).alias("link_logit"),
        F.when(F.col("vec_id") % 3 == 0, 0).otherwise(1).alias("link_label"),
    )
