"""Edges, nodes, clean-up, sequences and sampled pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.functions.scalar import epoch_seconds
from chronomesh.operators import dims, graph, sequence, timebin
from chronomesh.plans import inputs
from chronomesh.plans.inputs import AUTH_KEYS, BATCH_KEYS, KEYS, shared, whole
from chronomesh.plans.registry import part, query
from chronomesh.sources import views

B, WINDOW = views.CONN_BATCH, views.WINDOW
_KEYS_SQL = "CAST(file_id AS BIGINT) AS file_id, batch, bin"


@query("conn_edges", f"SELECT {_KEYS_SQL}, conn_id, piece, src, dst, round(ts, 6) AS ts, y FROM edges")
def conn_edges(spark, sf_dir):
    out = inputs.edges(spark, sf_dir).select(*KEYS, "conn_id", "piece", "src", "dst", F.round("ts", 6).alias("ts"), "y")
    return whole(out, "file_id", "bin", "y")


@query("auth_edges", "SELECT batch, bin, auth_id, src, dst, time, y FROM auth_edges_t")
def auth_edges(spark, sf_dir):
    return whole(inputs.auth_edges(spark, sf_dir).select(*AUTH_KEYS, "auth_id", "src", "dst", "time", "y"), "bin", "y")


def _feature_sql(names, prefix="f"):
    return ", ".join(
        f"coalesce(CAST({'CAST(' + n + ' AS INT)' if n.startswith('local_') else n} AS DOUBLE), 0) AS {prefix}{i}" for i, n in enumerate(names)
    )


def _unpacked(column: str, names, prefix="f"):
    return [F.element_at(column, i + 1).alias(f"{prefix}{i}") for i in range(len(names))]


@query("conn_edge_features", f"SELECT conn_id, piece, {_feature_sql(graph.CONN_FEATURES)} FROM edges")
def conn_edge_features(spark, sf_dir):
    edges = graph.with_attrs(inputs.binned(graph.conn_codes(inputs.relative(spark, sf_dir))), graph.CONN_FEATURES)
    return edges.select("conn_id", "piece", *_unpacked("attrs", graph.CONN_FEATURES))


@query("auth_edge_features", f"SELECT auth_id, {_feature_sql(graph.AUTH_FEATURES)} FROM auth_edges_t")
def auth_edge_features(spark, sf_dir):
    edges = graph.with_attrs(inputs.auth_edges(spark, sf_dir), graph.AUTH_FEATURES)
    return edges.select("auth_id", *_unpacked("attrs", graph.AUTH_FEATURES))


@query("node_degrees", f"SELECT {_KEYS_SQL}, node, CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree FROM degrees")
def node_degrees(spark, sf_dir):
    return whole(graph.node_degrees(inputs.edges(spark, sf_dir), KEYS), "file_id", "bin")


@query("node_features", f"""
SELECT {_KEYS_SQL}, node, {', '.join(f'CAST({f} AS BIGINT) AS {f}' for f in graph.HOST_FLAGS)},
       CAST(in_degree AS BIGINT) AS in_degree, CAST(out_degree AS BIGINT) AS out_degree
FROM degrees JOIN flags ON node = host_id
""")
def node_features(spark, sf_dir):
    hosts = inputs.hosts(spark, sf_dir)
    degrees = graph.node_degrees(inputs.edges(spark, sf_dir, hosts), KEYS)
    out = graph.node_features(degrees, dims.enrich_hosts(hosts), KEYS)
    return whole(out, "file_id", "bin", *graph.HOST_FLAGS)


#: What each edge attribute is divided by, so that all are of the order of one.
SCALE = {
    "status_code": 2.0, "src_port": 2000.0, "dest_port": 2000.0, "orig_bytes": 1e5, "orig_pkts": 50.0, "resp_bytes": 1e5, "resp_pkts": 50.0,
    "missed_bytes": 1.0, "local_orig": 1.0, "local_resp": 1.0, "duration": 1e4, "proto_code": 5.0, "service_code": 20.0, "conn_state_code": 10.0,
}


def scaled_columns(names: list[str]) -> dict:
    """The attributes as doubles, missing ones 0, on their scale."""
    return {n: c / F.lit(SCALE[n]) for n, c in zip(names, graph.feature_columns(names))}


def scaled_sql(names: list[str]) -> dict[str, str]:
    return {n: f"coalesce(CAST({'CAST(' + n + ' AS INT)' if n.startswith('local_') else n} AS DOUBLE), 0) / CAST({SCALE[n]} AS DOUBLE)" for n in names}


_DEDUP = {"add": "sum", "mean": "avg", "min": "min", "max": "max", "mul": "product"}
_ATTRS = graph.CONN_FEATURES


def _attr_edges(spark, sf_dir):
    return inputs.edges(spark, sf_dir).withColumns(scaled_columns(_ATTRS))


def _register_dedup(mode: str, sql_name: str) -> None:
    merged = ", ".join(f"round({sql_name}({v}), 11) AS {a}" for a, v in scaled_sql(_ATTRS).items())

    @query(f"dedup_edges_{mode}", f"SELECT {_KEYS_SQL}, src, dst, count(*) AS copies, {merged} FROM edges GROUP BY ALL")
    def dedup(spark, sf_dir):
        out = graph.dedup_edges(_attr_edges(spark, sf_dir), KEYS, _ATTRS, mode)
        return whole(out.withColumns({a: F.round(a, 11) for a in _ATTRS}), "file_id", "bin")


for _mode, _sql in _DEDUP.items():
    _register_dedup(_mode, _sql)


@query("dedup_edges_first", f"""
SELECT {_KEYS_SQL}, src, dst, count(*) AS copies, round(coalesce(arg_min(ts, (ts, conn_id, piece)), 0), 6) AS first_ts,
       arg_min(orig_pkts, (ts, conn_id, piece)) AS first_pkts FROM edges GROUP BY ALL
""")
def dedup_edges_first(spark, sf_dir):
    edges = inputs.edges(spark, sf_dir).withColumns({"first_ts": F.col("ts"), "first_pkts": F.col("orig_pkts")})
    out = graph.dedup_edges(edges, KEYS, ["first_ts", "first_pkts"], "first", ["ts", "conn_id", "piece"])
    return whole(out.withColumn("first_ts", F.round("first_ts", 6)), "file_id", "bin")


@query("remove_self_loops", f"SELECT {_KEYS_SQL}, conn_id, piece, src, dst FROM edges WHERE src <> dst")
def remove_self_loops(spark, sf_dir):
    out = graph.remove_self_loops(inputs.edges(spark, sf_dir)).select(*KEYS, "conn_id", "piece", "src", "dst")
    return whole(out, "file_id", "bin")


_AUTH_MERGED = ", ".join(f"max(coalesce(CAST({a} AS DOUBLE), 0)) AS {a}" for a in graph.AUTH_FEATURES)
part("auth_cleaned", f"SELECT batch, bin, src, dst, count(*) AS copies, max(y) AS y, CAST(max(time) AS BIGINT) AS time, {_AUTH_MERGED} FROM auth_edges_t WHERE src <> dst GROUP BY ALL")
part("auth_degrees", """
SELECT batch, bin, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
  SELECT batch, bin, src AS node, 0 AS i, 1 AS o FROM auth_cleaned UNION ALL SELECT batch, bin, dst, 1, 0 FROM auth_cleaned) GROUP BY ALL
""")


def _auth_cleaned(spark, sf_dir):
    """Duplicates merged, with all attributes, the label and the last time; then no self loops."""
    attrs = dict(zip(graph.AUTH_FEATURES, graph.feature_columns(graph.AUTH_FEATURES)))
    edges = inputs.auth_edges(spark, sf_dir).withColumns(attrs)
    return graph.remove_self_loops(graph.dedup_edges(edges, AUTH_KEYS, ["y", "time", *graph.AUTH_FEATURES], "max"))


@query("auth_graph_chain", "SELECT * FROM auth_degrees")
def auth_graph_chain(spark, sf_dir):
    """The authentication graph's clean-up in order: duplicates, self loops, degrees."""
    return whole(graph.node_degrees(_auth_cleaned(spark, sf_dir), AUTH_KEYS), "bin")


@query("auth_graph_edges", "SELECT * FROM auth_cleaned")
def auth_graph_edges(spark, sf_dir):
    """The edges that the chain leaves, with their attributes."""
    return whole(_auth_cleaned(spark, sf_dir), "bin", "y", "time")


part("typed", f"""
SELECT e.file_id, e.batch, e.bin, e.conn_id, e.piece, e.ts, e.y, e.src, e.dst, s.service_id AS ssv, d.service_id AS dsv,
       {_feature_sql(graph.HETERO_FEATURES, 'a')}
FROM edges e JOIN services s ON e.src_ip = s.host AND e.src_port = s.port JOIN services d ON e.dest_ip = d.host AND e.dest_port = d.port
""")
_NA = len(graph.HETERO_FEATURES)
_A = [f"a{i}" for i in range(_NA)]
_FOLD = " + ".join(f"{i + 1} * {a}" for i, a in enumerate(_A))
part("typed_edges", f"""
SELECT file_id, batch, bin, ts, y, 'uses' AS edge_type, 'host' AS src_type, src, 'service' AS dst_type, ssv AS dst, 0 AS width, 0.0::DOUBLE AS folded FROM typed
UNION ALL SELECT file_id, batch, bin, ts, y, 'communicates_with', 'service', ssv, 'service', dsv, {_NA}, {_FOLD} FROM typed
UNION ALL SELECT file_id, batch, bin, ts, y, 'belongs_to', 'service', dsv, 'host', dst, 0, 0.0 FROM typed
""")


def _folded(column: str):
    """A weighted sum of the attributes, so that a list compares as one number."""
    weighted = F.zip_with(column, F.sequence(F.lit(1), F.greatest(F.size(column), F.lit(1))), lambda a, i: coalesce0(a) * i)
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda acc, v: acc + v), 3)


def coalesce0(value):
    return F.coalesce(value, F.lit(0.0))


def _hetero(spark, sf_dir):
    conn = views.conn(spark, sf_dir)
    hosts, services = dims.host_map(conn), dims.service_map(conn)
    return hosts, services, graph.hetero_edges(inputs.hetero_input(spark, sf_dir, hosts, services), KEYS)


@query("hetero_edges", f"""
SELECT {_KEYS_SQL}, round(ts, 6) AS ts, y, edge_type, src_type, src, dst_type, dst, CAST(width AS BIGINT) AS width, round(folded, 3) AS folded FROM typed_edges
""")
def hetero_edges(spark, sf_dir):
    _, _, edges = _hetero(spark, sf_dir)
    out = edges.withColumns({"width": F.size("attrs"), "folded": _folded("attrs"), "ts": F.round("ts", 6)}).drop("attrs")
    return whole(out, "file_id", "bin", "y", "width")


@query("hetero_nodes_flat", f"""
SELECT host_id AS node, CAST(0 AS BIGINT) AS node_type, {', '.join(f'CAST(CAST({f} AS INT) AS DOUBLE) AS x{i}' for i, f in enumerate(graph.HOST_FLAGS))} FROM flags
UNION ALL SELECT service_id + (SELECT count(*) FROM hosts), 1, CAST(port AS DOUBLE), CAST(CAST(port < 1024 AS INT) AS DOUBLE), 0, 0, 0, 0 FROM services
""")
def hetero_nodes_flat(spark, sf_dir):
    conn = views.conn(spark, sf_dir)
    hosts, services = dims.host_map(conn), dims.service_map(conn)
    nodes = graph.flatten_nodes(dims.enrich_hosts(hosts), dims.enrich_services(services), hosts.count())
    return whole(nodes.select("node", "node_type", *_unpacked("x", graph.HOST_FLAGS, "x")), "node_type")


@query("hetero_edges_flat", f"""
SELECT {_KEYS_SQL}, round(ts, 6) AS ts, y, edge_type_code, src, dst, CAST({_NA} AS BIGINT) AS width, round(folded, 3) AS folded FROM (
  SELECT *  REPLACE (src + CASE WHEN src_type = 'service' THEN n ELSE 0 END AS src, dst + CASE WHEN dst_type = 'service' THEN n ELSE 0 END AS dst),
         CAST(list_position(['uses', 'communicates_with', 'belongs_to'], edge_type) - 1 AS BIGINT) AS edge_type_code
  FROM typed_edges, (SELECT count(*) AS n FROM hosts))
""")
def hetero_edges_flat(spark, sf_dir):
    hosts, _, edges = _hetero(spark, sf_dir)
    flat = graph.flatten_edges(edges, hosts.count())
    out = flat.select(*KEYS, F.round("ts", 6).alias("ts"), "y", "edge_type_code", "src", "dst",
                      F.size("attrs").alias("width"), _folded("attrs").alias("folded"))
    return whole(out, "file_id", "bin", "y", "edge_type_code", "width")


@query("graph_stats", f"""
SELECT {_KEYS_SQL}, coalesce(n, 0) AS edges, coalesce(a, 0) AS active_nodes
FROM spine LEFT JOIN (SELECT file_id, batch, bin, count(*) AS n FROM edges GROUP BY ALL) USING (file_id, batch, bin)
LEFT JOIN (SELECT file_id, batch, bin, count(*) AS a FROM degrees GROUP BY ALL) USING (file_id, batch, bin)
""")
def graph_stats(spark, sf_dir):
    edges = shared(inputs.edges(spark, sf_dir).select(*KEYS, "src", "dst"), "edges")
    return whole(graph.graph_stats(edges, timebin.bin_spine(edges, BATCH_KEYS, B), KEYS), "file_id", "bin")


part("timeline", """
SELECT s.file_id, s.batch, n.node, s.bin, coalesce(in_degree, 0) AS i, coalesce(out_degree, 0) AS o
FROM spine s JOIN (SELECT DISTINCT file_id, batch, node FROM degrees) n USING (file_id, batch)
LEFT JOIN degrees d ON d.file_id = s.file_id AND d.batch = s.batch AND d.bin = s.bin AND d.node = n.node
""")


def timelines(spark, sf_dir):
    """In and out degree of every node active in a batch, for all bins of the batch."""
    degrees = graph.node_degrees(inputs.edges(spark, sf_dir), KEYS)
    return sequence.batch_timelines(degrees, BATCH_KEYS, B, ["in_degree", "out_degree"])


@query("sliding_sequences", f"""
SELECT CAST(t.file_id AS BIGINT) AS file_id, t.batch, t.node, CAST(g AS BIGINT) AS target,
       string_agg(concat(CAST(i AS BIGINT), '|', CAST(o AS BIGINT)), ',' ORDER BY bin) AS series
FROM timeline t JOIN (SELECT unnest(range({WINDOW}, {B})) AS g) ON t.bin >= g - {WINDOW} AND t.bin < g
GROUP BY t.file_id, t.batch, t.node, g
""")
def sliding_sequences(spark, sf_dir):
    """Degrees are put into text per bin once, then cut into windows."""
    text = F.transform("timeline", lambda x: F.concat_ws("|", F.transform(x, lambda v: v.cast("bigint").cast("string"))))
    lines = timelines(spark, sf_dir).withColumn("timeline", text)
    seqs = sequence.sliding_sequences(lines, B, WINDOW)
    return whole(seqs.select(*BATCH_KEYS, "node", "target", F.array_join("seq", ",").alias("series")), "file_id", "target")


@query("eligible_windows", f"""
SELECT CAST(file_id AS BIGINT) AS file_id, batch, count(*) AS bins, CAST({WINDOW} AS BIGINT) AS first_target, count(*) - 2 AS last_target, count(*) - {WINDOW} - 1 AS windows
FROM spine GROUP BY file_id, batch HAVING count(*) >= {WINDOW} + 2
""")
def eligible_windows(spark, sf_dir):
    spine = timebin.bin_spine(inputs.conn_binned(spark, sf_dir), BATCH_KEYS, B)
    return whole(sequence.eligible_windows(spine, BATCH_KEYS, WINDOW, drop_last=1), "file_id", "first_target", "last_target")


@query("last_value_embedding", f"""
SELECT CAST(file_id AS BIGINT) AS file_id, batch, node, bin + 1 AS target, CAST(i AS DOUBLE) AS x0, CAST(o AS DOUBLE) AS x1
FROM timeline WHERE bin BETWEEN {WINDOW - 1} AND {B - 2}
""")
def last_value_embedding(spark, sf_dir):
    last = sequence.last_values(timelines(spark, sf_dir), B, WINDOW)
    out = last.select(*BATCH_KEYS, "node", "target", F.element_at("x", 1).alias("x0"), F.element_at("x", 2).alias("x1"))
    return whole(out, "file_id", "target")


@query("positive_edges", f"SELECT {_KEYS_SQL}, conn_id, piece, src, dst, y FROM edges WHERE bin >= {WINDOW}")
def positive_edges(spark, sf_dir):
    out = sequence.positive_edges(inputs.edges(spark, sf_dir), WINDOW).select(*KEYS, "conn_id", "piece", "src", "dst", "y")
    return whole(out, "file_id", "bin", "y")


def population_sql(count: str) -> str:
    """Nodes n, ordered pairs p, and the stride: the first number from the golden section of p upwards that is coprime to it."""
    return f"""
SELECT n, p, (SELECT min(c) FROM (SELECT unnest(range(p * 618033989 // 1000000000, p * 618033989 // 1000000000 + 200)) AS c) WHERE gcd(c, p) = 1) AS step
FROM (SELECT n, n * (n - 1) AS p FROM ({count}))
"""


part("population", population_sql("SELECT count(*) AS n FROM hosts"))
part("positives", f"SELECT file_id, batch, bin, src, dst, y FROM edges WHERE bin >= {WINDOW}")


def negatives_sql(minimum: int, positives: str = "positives", population: str = "population") -> str:
    return f"""
SELECT file_id, batch, bin, draw, src, dst FROM (
  SELECT file_id, batch, bin, wanted, src, dst, row_number() OVER (PARTITION BY file_id, batch, bin ORDER BY i) AS draw FROM (
    SELECT file_id, batch, bin, wanted, i, code // (n - 1) AS src, code % (n - 1) + CASE WHEN code % (n - 1) >= code // (n - 1) THEN 1 ELSE 0 END AS dst
    FROM (SELECT *, CAST((CAST(('0x' || substr(md5(concat('42:', file_id, ':', batch, ':', bin)), 1, 15)) AS BIGINT) % p + i * step) % p AS BIGINT) AS code
          FROM (SELECT *, unnest(range(wanted + pairs)) AS i FROM (
            SELECT file_id, batch, bin, n, p, step, count(DISTINCT CASE WHEN src <> dst THEN (src, dst) END) AS pairs,
                   CAST(least(greatest(count(*), {minimum}), p - count(DISTINCT CASE WHEN src <> dst THEN (src, dst) END)) AS BIGINT) AS wanted
            FROM {positives}, {population} GROUP BY file_id, batch, bin, n, p, step))))
  c WHERE NOT EXISTS (SELECT 1 FROM {positives} q WHERE q.file_id = c.file_id AND q.batch = c.batch AND q.bin = c.bin AND q.src = c.src AND q.dst = c.dst))
WHERE draw <= wanted
"""


part("negatives", negatives_sql(0))


def pairs_input(spark, sf_dir):
    """Positive edges and the number of known hosts."""
    hosts = inputs.hosts(spark, sf_dir)
    edges = sequence.positive_edges(inputs.edges(spark, sf_dir, hosts), WINDOW)
    return shared(edges.select(*KEYS, "conn_id", "piece", "src", "dst", "y"), "positives"), hosts.count()


@query("negative_edges", f"SELECT {_KEYS_SQL}, draw, src, dst FROM negatives")
def negative_edges(spark, sf_dir):
    positives, hosts = pairs_input(spark, sf_dir)
    return whole(graph.negative_edges(positives, hosts, KEYS), "file_id", "bin", "draw")


@query("negative_edges_minimum", f"SELECT {_KEYS_SQL}, draw, src, dst FROM ({negatives_sql(20)})")
def negative_edges_minimum(spark, sf_dir):
    """The variant that draws at least 20 per graph."""
    positives, hosts = pairs_input(spark, sf_dir)
    return whole(graph.negative_edges(positives, hosts, KEYS, minimum=20), "file_id", "bin", "draw")


def _pairs_sql(link: str) -> str:
    return f"""
SELECT {_KEYS_SQL}, src, dst, CAST(1 AS BIGINT) AS observed, CAST({link} AS BIGINT) AS link_target, y AS class_target FROM positives
UNION ALL SELECT {_KEYS_SQL}, src, dst, 0, 0, 0 FROM negatives
"""


@query("training_pairs", _pairs_sql("y = 0"))
def training_pairs(spark, sf_dir):
    positives, hosts = pairs_input(spark, sf_dir)
    out = graph.training_pairs(positives, graph.negative_edges(positives, hosts, KEYS), KEYS)
    return whole(out, "file_id", "bin", "observed", "link_target", "class_target")


@query("training_pairs_observed", _pairs_sql("1"))
def training_pairs_observed(spark, sf_dir):
    positives, hosts = pairs_input(spark, sf_dir)
    out = graph.training_pairs(positives, graph.negative_edges(positives, hosts, KEYS), KEYS, "observed")
    return whole(out, "file_id", "bin", "observed", "link_target", "class_target")


part("trade", """
SELECT CAST(floor(epoch(l_shipdate) / 2592000) AS BIGINT) AS batch, CAST(floor(epoch(l_shipdate) / 86400) - floor(epoch(l_shipdate) / 2592000) * 30 AS BIGINT) AS bin,
       l_suppkey AS src, l_partkey AS dst, l_quantity, l_returnflag FROM lineitem
""")


def trade(spark, sf_dir):
    """Line items as edges from supplier to part, in daily bins."""
    items = views.table(spark, sf_dir, "lineitem").select(
        epoch_seconds(F.col("l_shipdate")).alias("time"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"),
        "l_quantity", "l_returnflag",
    )
    return timebin.bin_events(items, "time", 86400, 30)


@query("trade_degrees", """
SELECT batch, bin, node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
FROM (SELECT batch, bin, src AS node, 0 AS i, 1 AS o FROM trade UNION ALL SELECT batch, bin, dst, 1, 0 FROM trade) GROUP BY ALL
""")
def trade_degrees(spark, sf_dir):
    return whole(graph.node_degrees(trade(spark, sf_dir), AUTH_KEYS), "bin")


@query("trade_dedup", "SELECT batch, bin, src, dst, count(*) AS copies, sum(l_quantity) AS l_quantity FROM trade GROUP BY ALL")
def trade_dedup(spark, sf_dir):
    return whole(graph.dedup_edges(trade(spark, sf_dir), AUTH_KEYS, ["l_quantity"], "add"), "bin")


@query("trade_novelty", """
SELECT s.batch, s.bin, count(CASE WHEN f = 'p' THEN 1 END) AS new_parts, count(CASE WHEN f = 's' THEN 1 END) AS new_suppliers
FROM (SELECT batch, CAST(unnest(range(30)) AS BIGINT) AS bin FROM (SELECT DISTINCT batch FROM trade)) s
LEFT JOIN (SELECT 'p' AS f, min(batch * 30 + bin) AS place FROM trade GROUP BY dst UNION ALL SELECT 's', min(batch * 30 + bin) FROM trade GROUP BY src) v
  ON v.place = s.batch * 30 + s.bin GROUP BY s.batch, s.bin
""")
def trade_novelty(spark, sf_dir):
    from chronomesh.operators.stats import novelty

    return whole(novelty(trade(spark, sf_dir), ["batch"], 30, [], {"parts": [["dst"]], "suppliers": [["src"]]}), "bin")
