"""Dimension tables: hosts, services, users, and the codes taken from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.functions.addresses import with_address_flags
from chronomesh.operators.scaling import dense_index


def distinct_ends(df: DataFrame, ends: list[list[str]], names: list[str]) -> DataFrame:
    """Distinct values over several column sets, read in one scan.

    ``ends=[["src_ip"], ["dest_ip"]], names=["host"]`` is the set union of both columns.
    Nulls are no values. The distinct combines on the map side, so a hot value costs
    one row per task.
    """
    rows = F.array(*[F.struct(*[F.col(c).alias(n) for c, n in zip(cols, names)]) for cols in ends])
    flat = df.select(F.inline(rows))
    return flat.filter(F.col(names[0]).isNotNull()).distinct()


def build_map(df: DataFrame, ends: list[list[str]], names: list[str], id_name: str) -> DataFrame:
    """Distinct values with dense ids in sorted order."""
    return dense_index(distinct_ends(df, ends, names), list(names), id_name).select(id_name, *names)


def new_entries(known: DataFrame, df: DataFrame, ends: list[list[str]], names: list[str], id_name: str) -> DataFrame:
    """Values that ``known`` lacks, numbered after its highest id in sorted order: the rows to append to it.

    Ids of known values stay, so edges stored with them stay valid when a further load arrives.
    """
    values = distinct_ends(df, ends, names)
    same = [F.col(n).eqNullSafe(F.col(f"_k_{n}")) for n in names]
    fresh = values.join(known.select(*[F.col(n).alias(f"_k_{n}") for n in names]), same, "left_anti")
    start = known.agg(F.max(id_name)).first()[0]
    numbered = dense_index(fresh, list(names), id_name)
    return numbered.select((F.col(id_name) + F.lit(0 if start is None else start + 1)).alias(id_name), *names)


def extend_map(known: DataFrame, df: DataFrame, ends: list[list[str]], names: list[str], id_name: str) -> DataFrame:
    """``known`` and its new entries."""
    return known.select(id_name, *names).unionByName(new_entries(known, df, ends, names, id_name))


def host_map(conn: DataFrame) -> DataFrame:
    return build_map(conn, [["src_ip"], ["dest_ip"]], ["host"], "host_id")


def service_map(conn: DataFrame) -> DataFrame:
    return build_map(conn, [["src_ip", "src_port"], ["dest_ip", "dest_port"]], ["host", "port"], "service_id")


def auth_host_map(auth: DataFrame) -> DataFrame:
    return build_map(auth, [["src_computer"], ["dst_computer"]], ["host"], "host_id")


def auth_user_map(auth: DataFrame) -> DataFrame:
    return build_map(auth, [["src_user"], ["dst_user"]], ["user_name"], "user_id")


def encode(df: DataFrame, dimension: DataFrame, on: dict[str, str], id_name: str, alias: str) -> DataFrame:
    """Left lookup of an id: ``on`` maps event columns to dimension columns.

    No broadcast hint. The dimension is a staged table, so Catalyst knows its size and
    broadcasts it only under the threshold; above it, AQE splits hot keys of the
    sort-merge join over many tasks.
    """
    keyed = dimension.select(*[F.col(d).alias(f"_k_{e}") for e, d in on.items()], F.col(id_name).alias(alias))
    condition = [F.col(e) == F.col(f"_k_{e}") for e in on]
    return df.join(keyed, condition, "left").drop(*[f"_k_{e}" for e in on])


def encode_hosts(df: DataFrame, hosts: DataFrame, src: str = "src_ip", dst: str = "dest_ip") -> DataFrame:
    return encode(encode(df, hosts, {src: "host"}, "host_id", "src"), hosts, {dst: "host"}, "host_id", "dst")


def encode_services(df: DataFrame, services: DataFrame) -> DataFrame:
    out = encode(df, services, {"src_ip": "host", "src_port": "port"}, "service_id", "src_service_id")
    return encode(out, services, {"dest_ip": "host", "dest_port": "port"}, "service_id", "dest_service_id")


def enrich_hosts(hosts: DataFrame, host: str = "host") -> DataFrame:
    """Add internal, broadcast, multicast, ipv4, ipv6 and valid flags."""
    return with_address_flags(hosts, host)


def enrich_services(services: DataFrame) -> DataFrame:
    return services.withColumn("is_known", F.col("port") < 1024)


def duplicate_keys(dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; a many-to-one join needs this to be empty."""
    return dimension.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def require_unique(dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Return ``dimension`` unchanged, or raise when a key repeats."""
    if duplicate_keys(dimension, keys).limit(1).count():
        raise ValueError(f"dimension key {keys} is not unique")
    return dimension
