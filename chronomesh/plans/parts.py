"""Shared sub-queries of the check SQL, in DuckDB's dialect."""

from __future__ import annotations

from chronomesh.operators.split import FRACTIONS
from chronomesh.plans.registry import part
from chronomesh.sources import schemas, views


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v) for v in values) + "]"


def code(column: str, dictionary: list[str]) -> str:
    return f"CAST(CASE WHEN {column} IS NULL THEN NULL ELSE list_position({sql_list(dictionary)}, {column}) - 1 END AS BIGINT)"


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{text} AS {name}" for name, text in columns.items())


part("conn", f"""
SELECT {select_list(views.CONN_COLUMNS)}
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, epoch_us(ts) / 1e6 AS es FROM events)
""")
part("auth", f"""
SELECT {select_list(views.AUTH_COLUMNS)}
FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS es FROM orders JOIN customer ON o_custkey = c_custkey)
""")
part("redteam", """
SELECT time, src_user AS user_name, src_computer, dst_computer FROM auth WHERE auth_id % 50 = 0
UNION ALL SELECT time, dst_user, src_computer, dst_computer FROM auth WHERE auth_id % 75 = 0
UNION ALL SELECT time, src_user, src_computer, dst_computer FROM auth WHERE auth_id % 100 = 0
""")
part("emb", "SELECT vec_id, embedding, label FROM embeddings")
part("pred", """
SELECT CAST(doc_id % 8 AS INT) AS batch, doc_id, CAST((n_chars % 100 - 50) / 10.0 AS DOUBLE) AS logit,
       round(1 / (1 + exp(-CAST((n_chars % 100 - 50) / 10.0 AS DOUBLE))), 6) AS score,
       quality AS label, toxic AS malicious
FROM labels JOIN documents USING (doc_id)
""")
part("class_pred", """
SELECT CAST(vec_id % 4 AS INT) AS batch, vec_id AS edge_id,
       list_transform(embedding[1:10], lambda v: CAST(v AS DOUBLE)) AS logits, label,
       CAST(embedding[11] AS DOUBLE) AS link_logit, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS link_label
FROM embeddings
""")
part("rel", f"SELECT * REPLACE (ts - {float(views.FIRST_EVENT)} AS ts), ts AS abs_ts FROM conn")
part("counted", f"SELECT *, greatest(1, CAST(ceil(coalesce(duration, 0) / {views.CONN_BIN}) AS BIGINT)) AS pieces FROM rel")
part("spread", """
SELECT c.* EXCLUDE (pieces) REPLACE (
         CASE WHEN p = pieces - 1 THEN ts ELSE ts - duration + p * %d END AS ts), p AS piece,
       CASE WHEN p = pieces - 1 THEN 'closing' WHEN p = 0 THEN 'starting' ELSE 'open' END AS conn_status
FROM (SELECT *, unnest(range(pieces)) AS p FROM counted) c
""" % views.CONN_BIN)
part("spread_cols", "SELECT * EXCLUDE (p) FROM spread")
part("expanded", f"SELECT *, {code('conn_status', schemas.CONN_STATUS)} AS status_code FROM spread_cols WHERE ts >= 0")
part("hosts", """
SELECT row_number() OVER (ORDER BY host) - 1 AS host_id, host
FROM (SELECT src_ip AS host FROM conn UNION SELECT dest_ip FROM conn)
""")
part("services", """
SELECT row_number() OVER (ORDER BY host, port) - 1 AS service_id, host, port
FROM (SELECT src_ip AS host, src_port AS port FROM conn UNION SELECT dest_ip, dest_port FROM conn)
""")
part("auth_hosts", """
SELECT row_number() OVER (ORDER BY host) - 1 AS host_id, host
FROM (SELECT src_computer AS host FROM auth UNION SELECT dst_computer FROM auth)
""")
part("auth_users", """
SELECT row_number() OVER (ORDER BY user_name) - 1 AS user_id, user_name
FROM (SELECT src_user AS user_name FROM auth UNION SELECT dst_user FROM auth)
""")


def binned(source: str, ts: str, width: int, size: int) -> str:
    return f"""
SELECT *, CAST(floor({ts} / {width}) AS BIGINT) AS bin_abs,
       CAST(floor(floor({ts} / {width}) / {size}) AS BIGINT) AS batch,
       CAST(floor({ts} / {width}) - floor(floor({ts} / {width}) / {size}) * {size} AS BIGINT) AS bin
FROM {source}
"""


part("plain_binned", binned("rel", "ts", views.CONN_BIN, views.CONN_BATCH))
part("binned", binned("expanded", "ts", views.CONN_BIN, views.CONN_BATCH))
part("auth_binned", binned("auth", "time", views.AUTH_BIN, views.AUTH_BATCH))


def split(source: str, by: str | None) -> str:
    keys = f"{by}, batch" if by else "batch"
    window = f"PARTITION BY {by}" if by else ""
    text = f"concat('42:', {by}, ':', batch)" if by else "concat('42:', batch)"
    f1, f2, f3 = FRACTIONS
    return f"""
SELECT {keys}, CASE WHEN r <= b1 + (CASE WHEN n - b1 - b2 - b3 >= 1 THEN 1 ELSE 0 END) THEN 0
            WHEN r <= b1 + (CASE WHEN n - b1 - b2 - b3 >= 1 THEN 1 ELSE 0 END)
                    + b2 + (CASE WHEN n - b1 - b2 - b3 >= 2 THEN 1 ELSE 0 END) THEN 1 ELSE 2 END AS stage
FROM (SELECT *, floor(n * CAST({f1} AS DOUBLE)) AS b1, floor(n * CAST({f2} AS DOUBLE)) AS b2, floor(n * CAST({f3} AS DOUBLE)) AS b3
      FROM (SELECT {keys}, row_number() OVER ({window} ORDER BY md5({text})) AS r, count(*) OVER ({window}) AS n
            FROM (SELECT DISTINCT {keys} FROM {source})))
"""


part("conn_split", split("binned", "file_id"))
part("auth_split", split("auth_binned", None))
part("encoded", """
SELECT b.*, s.host_id AS src, d.host_id AS dst
FROM binned b LEFT JOIN hosts s ON b.src_ip = s.host LEFT JOIN hosts d ON b.dest_ip = d.host
""")
part("edges", f"""
SELECT file_id, batch, bin, conn_id, piece, src, dst, ts, {code('label_tactic', schemas.LABEL_TACTIC)} AS y,
       status_code, src_port, dest_port, orig_bytes, orig_pkts, resp_bytes, resp_pkts, missed_bytes,
       local_orig, local_resp, duration, {code('proto', schemas.PROTO)} AS proto_code,
       {code('service', schemas.SERVICE)} AS service_code, {code('conn_state', schemas.CONN_STATE)} AS conn_state_code,
       src_ip, dest_ip
FROM encoded
""")
part("auth_marked", """
SELECT a.*, EXISTS (SELECT 1 FROM redteam r WHERE r.time = a.time AND r.user_name = a.src_user
                    AND r.src_computer = a.src_computer AND r.dst_computer = a.dst_computer)
         OR EXISTS (SELECT 1 FROM redteam r WHERE r.time = a.time AND r.user_name = a.dst_user
                    AND r.src_computer = a.src_computer AND r.dst_computer = a.dst_computer) AS malicious
FROM auth_binned a
""")
part("auth_edges_t", f"""
SELECT a.batch, a.bin, a.auth_id, s.host_id AS src, d.host_id AS dst, a.time, CAST(a.malicious AS BIGINT) AS y,
       {code('auth_type', schemas.AUTH_TYPE)} AS auth_type_code, {code('logon_type', schemas.LOGON_TYPE)} AS logon_type_code,
       {code('orientation', schemas.ORIENTATION)} AS orientation_code, {code('result', schemas.RESULT)} AS result_code
FROM auth_marked a JOIN auth_hosts s ON a.src_computer = s.host JOIN auth_hosts d ON a.dst_computer = d.host
""")
part("degrees", """
SELECT file_id, batch, bin, node, sum(i) AS in_degree, sum(o) AS out_degree
FROM (SELECT file_id, batch, bin, src AS node, 0 AS i, 1 AS o FROM edges
      UNION ALL SELECT file_id, batch, bin, dst, 1, 0 FROM edges)
GROUP BY ALL
""")
part("flags", """
SELECT host_id, host,
       host LIKE '10.0.%' OR host LIKE '192.168.%' OR host = '255.255.255.255' OR host LIKE 'fe80::%' AS internal,
       host = '255.255.255.255' AS broadcast, host LIKE '224.0.0.%' AS multicast,
       regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS ipv4, host LIKE 'fe80::%' AS ipv6,
       host NOT LIKE 'host-%' AS valid
FROM hosts
""")
part("spine", f"""
SELECT file_id, batch, CAST(unnest(range({views.CONN_BATCH})) AS BIGINT) AS bin FROM (SELECT DISTINCT file_id, batch FROM binned)
""")
