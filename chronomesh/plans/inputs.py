"""Prepared inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.operators import dims, graph, label, split, timebin
from chronomesh.operators.scaling import stage
from chronomesh.sources import views

KEYS = ["file_id", "batch", "bin"]
BATCH_KEYS = ["file_id", "batch"]
AUTH_KEYS = ["batch", "bin"]


def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timebin.relative_time(views.conn(spark, sf_dir), float(views.FIRST_EVENT))


def relative_between(spark: SparkSession, sf_dir: str, lo: float | None, hi: float | None) -> DataFrame:
    """Connections near a range of relative time; the caller filters exactly."""
    near = timebin.near_range(views.conn(spark, sf_dir), float(views.FIRST_EVENT), lo, hi)
    return timebin.relative_time(near, float(views.FIRST_EVENT))


def expanded(conn: DataFrame) -> DataFrame:
    return timebin.expand_duration(conn, views.CONN_BIN)


def binned(conn: DataFrame) -> DataFrame:
    """Expanded connections with their bin and batch."""
    return timebin.bin_events(expanded(conn), "ts", views.CONN_BIN, views.CONN_BATCH)


def conn_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(relative(spark, sf_dir))


def conn_plain_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timebin.bin_events(relative(spark, sf_dir), "ts", views.CONN_BIN, views.CONN_BATCH)


def auth_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timebin.bin_events(views.auth(spark, sf_dir), "time", views.AUTH_BIN, views.AUTH_BATCH)


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.host_map(views.conn(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str, host_table: DataFrame | None = None) -> DataFrame:
    """Connection edges by host id. Ids and codes are looked up before an event is
    unrolled over its bins, so the joins see each event once.
    """
    table = hosts(spark, sf_dir) if host_table is None else host_table
    coded = graph.conn_codes(dims.encode_hosts(relative(spark, sf_dir), table))
    return binned(coded)


def hetero_input(spark: SparkSession, sf_dir: str, host_table: DataFrame, service_table: DataFrame) -> DataFrame:
    rel = dims.encode_services(dims.encode_hosts(relative(spark, sf_dir), host_table), service_table)
    return binned(graph.conn_codes(rel))


def auth_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = views.auth(spark, sf_dir)
    table = dims.auth_host_map(log)
    marked = label.label_redteam(log, views.redteam(log))
    coded = graph.auth_codes(dims.encode_hosts(marked, table, "src_computer", "dst_computer"))
    return timebin.bin_events(coded, "time", views.AUTH_BIN, views.AUTH_BATCH).withColumn("y", F.col("malicious").cast("int"))


def conn_split(events: DataFrame) -> DataFrame:
    return split.split_batches(events, ["file_id"])


def auth_split(events: DataFrame) -> DataFrame:
    return split.split_batches(events, [])


def shared(df: DataFrame, tag: str) -> DataFrame:
    """Write an input that a query reads more than once."""
    return stage(df, tag)


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """Cast integer columns to 64 bits so both engines report one type."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
