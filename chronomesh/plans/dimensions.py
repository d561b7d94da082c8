"""Dimension tables, encodings and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.functions.scalar import dictionary_code
from chronomesh.operators import dims, label
from chronomesh.operators.graph import HOST_FLAGS
from chronomesh.plans import inputs
from chronomesh.plans.inputs import whole
from chronomesh.plans.parts import code
from chronomesh.plans.registry import part, query
from chronomesh.sources import schemas, views


@query("host_map", "SELECT host_id, host FROM hosts")
def host_map(spark, sf_dir):
    return inputs.hosts(spark, sf_dir)


@query("service_map", "SELECT service_id, host, CAST(port AS BIGINT) AS port FROM services")
def service_map(spark, sf_dir):
    return whole(dims.service_map(views.conn(spark, sf_dir)), "port")


_FIRST_LOAD = "(SELECT * FROM conn WHERE file_id < 1)"


def _extended_sql(names: str, ends: list[str], id_name: str) -> str:
    """Ids of the first load, then those of what the second one adds."""
    both = [" UNION ".join(f"SELECT {e} FROM {source}" for e in ends) for source in (_FIRST_LOAD, "conn")]
    return f"""
WITH first_load AS (SELECT row_number() OVER (ORDER BY {names}) - 1 AS {id_name}, {names} FROM ({both[0]}))
SELECT * FROM first_load UNION ALL
SELECT row_number() OVER (ORDER BY {names}) - 1 + (SELECT count(*) FROM first_load), {names}
FROM (SELECT {names} FROM ({both[1]}) EXCEPT SELECT {names} FROM first_load)
"""


def _two_loads(spark, sf_dir, build, ends, names, id_name):
    conn = views.conn(spark, sf_dir)
    known = inputs.shared(build(conn.filter("file_id < 1")), "known")
    return dims.extend_map(known, conn, ends, names, id_name)


part("hosts_extended", _extended_sql("host", ["src_ip AS host", "dest_ip"], "host_id"))
part("services_extended", _extended_sql("host, port", ["src_ip AS host, src_port AS port", "dest_ip, dest_port"], "service_id"))


@query("host_map_extended", "SELECT * FROM hosts_extended")
def host_map_extended(spark, sf_dir):
    """The second week's hosts get numbers behind those of the first, which stay."""
    return _two_loads(spark, sf_dir, dims.host_map, [["src_ip"], ["dest_ip"]], ["host"], "host_id")


@query("service_map_extended", "SELECT service_id, host, CAST(port AS BIGINT) AS port FROM services_extended")
def service_map_extended(spark, sf_dir):
    ends = [["src_ip", "src_port"], ["dest_ip", "dest_port"]]
    return whole(_two_loads(spark, sf_dir, dims.service_map, ends, ["host", "port"], "service_id"), "port")


@query("auth_host_map", "SELECT host_id, host FROM auth_hosts")
def auth_host_map(spark, sf_dir):
    return dims.auth_host_map(views.auth(spark, sf_dir))


@query("auth_user_map", "SELECT user_id, user_name FROM auth_users")
def auth_user_map(spark, sf_dir):
    return dims.auth_user_map(views.auth(spark, sf_dir))


_CODES = {"proto": schemas.PROTO, "service": schemas.SERVICE, "conn_state": schemas.CONN_STATE, "label_tactic": schemas.LABEL_TACTIC}


@query("enum_encode", "SELECT conn_id, " + ", ".join(f"coalesce({code(c, d)}, -1) AS {c}_code" for c, d in _CODES.items()) + " FROM conn")
def enum_encode(spark, sf_dir):
    return views.conn(spark, sf_dir).select(
        "conn_id", *[F.coalesce(dictionary_code(F.col(c), d), F.lit(-1)).cast("bigint").alias(f"{c}_code") for c, d in _CODES.items()]
    )


@query("host_encode", """
SELECT conn_id, s.host_id AS src, d.host_id AS dst
FROM conn LEFT JOIN hosts s ON src_ip = s.host LEFT JOIN hosts d ON dest_ip = d.host
""")
def host_encode(spark, sf_dir):
    conn = views.conn(spark, sf_dir)
    return dims.encode_hosts(conn, dims.host_map(conn)).select("conn_id", "src", "dst")


@query("auth_encode", """
SELECT auth_id, s.user_id AS src_user_id, d.user_id AS dst_user_id, h.host_id AS src, t.host_id AS dst
FROM auth JOIN auth_users s ON src_user = s.user_name JOIN auth_users d ON dst_user = d.user_name
     JOIN auth_hosts h ON src_computer = h.host JOIN auth_hosts t ON dst_computer = t.host
""")
def auth_encode(spark, sf_dir):
    log = views.auth(spark, sf_dir)
    users = dims.auth_user_map(log)
    out = dims.encode(log, users, {"src_user": "user_name"}, "user_id", "src_user_id")
    out = dims.encode(out, users, {"dst_user": "user_name"}, "user_id", "dst_user_id")
    out = dims.encode_hosts(out, dims.auth_host_map(log), "src_computer", "dst_computer")
    return out.select("auth_id", "src_user_id", "dst_user_id", "src", "dst")


@query("host_enrichment", f"SELECT host_id, host, {', '.join(HOST_FLAGS)} FROM flags")
def host_enrichment(spark, sf_dir):
    return dims.enrich_hosts(inputs.hosts(spark, sf_dir))


@query("service_enrichment", "SELECT service_id, host, CAST(port AS BIGINT) AS port, port < 1024 AS is_known FROM services")
def service_enrichment(spark, sf_dir):
    return whole(dims.enrich_services(dims.service_map(views.conn(spark, sf_dir))), "port")


@query("dimension_key_check", """
SELECT host, count(*) AS copies FROM services GROUP BY host HAVING count(*) > 1
""")
def dimension_key_check(spark, sf_dir):
    """Hosts alone are no key of the service map; (host, port) is, which is required first."""
    services = dims.require_unique(dims.service_map(views.conn(spark, sf_dir)), ["host", "port"])
    return dims.duplicate_keys(services, ["host"])


@query("join_services", """
SELECT conn_id, s.service_id AS src_service_id, d.service_id AS dest_service_id
FROM conn LEFT JOIN services s ON src_ip = s.host AND src_port = s.port
          LEFT JOIN services d ON dest_ip = d.host AND dest_port = d.port
""")
def join_services(spark, sf_dir):
    conn = views.conn(spark, sf_dir)
    return dims.encode_services(conn, dims.service_map(conn)).select("conn_id", "src_service_id", "dest_service_id")


@query("redteam_label", "SELECT auth_id, time, malicious FROM auth_marked")
def redteam_label(spark, sf_dir):
    log = views.auth(spark, sf_dir)
    return label.label_redteam(log, views.redteam(log)).select("auth_id", "time", "malicious")


@query("malicious_flag", "SELECT conn_id, label_tactic IS DISTINCT FROM 'none' AS mal FROM conn")
def malicious_flag(spark, sf_dir):
    return label.malicious_flag(views.conn(spark, sf_dir)).select("conn_id", "mal")


@query("ts_log", "SELECT conn_id, round(ln(1 + ts), 6) AS ts_log FROM rel")
def ts_log(spark, sf_dir):
    return label.log_time(inputs.relative(spark, sf_dir)).select("conn_id", F.round("ts_log", 6).alias("ts_log"))
