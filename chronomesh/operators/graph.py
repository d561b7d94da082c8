"""Graph snapshots as edge and node tables keyed by (batch, bin)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.scalar import dictionary_code, md5_int
from chronomesh.operators.scaling import stage
from chronomesh.operators.split import seeded
from chronomesh.sources import schemas

#: Feature order of the homogeneous connection graph.
CONN_FEATURES = [
    "status_code", "src_port", "dest_port", "orig_bytes", "orig_pkts", "resp_bytes", "resp_pkts",
    "missed_bytes", "local_orig", "local_resp", "duration", "proto_code", "service_code", "conn_state_code",
]
#: Feature order on the service-to-service edges of the heterogeneous graph.
HETERO_FEATURES = [c for c in CONN_FEATURES if c not in ("src_port", "dest_port")]
#: Feature order of the authentication graph.
AUTH_FEATURES = ["auth_type_code", "logon_type_code", "orientation_code", "result_code"]
#: Node flags, in the order in which trained models expect them.
HOST_FLAGS = ["internal", "broadcast", "multicast", "ipv4", "ipv6", "valid"]

#: Candidate block length for negative sampling; one block is one task's unit of work.
BLOCK = 65536


def conn_codes(df: DataFrame) -> DataFrame:
    """Physical codes of the closed dictionaries; an unknown value raises."""
    return df.withColumns({
        "proto_code": dictionary_code(F.col("proto"), schemas.PROTO),
        "service_code": dictionary_code(F.col("service"), schemas.SERVICE),
        "conn_state_code": dictionary_code(F.col("conn_state"), schemas.CONN_STATE),
        "y": dictionary_code(F.col("label_tactic"), schemas.LABEL_TACTIC),
    })


def auth_codes(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "auth_type_code": dictionary_code(F.col("auth_type"), schemas.AUTH_TYPE),
        "logon_type_code": dictionary_code(F.col("logon_type"), schemas.LOGON_TYPE),
        "orientation_code": dictionary_code(F.col("orientation"), schemas.ORIENTATION),
        "result_code": dictionary_code(F.col("result"), schemas.RESULT),
    })


def feature_columns(names: list[str]):
    """Features as doubles, missing ones 0."""
    return [F.coalesce(F.col(n).cast("int").cast("double") if n.startswith("local_") else F.col(n).cast("double"), F.lit(0.0)) for n in names]


def with_attrs(df: DataFrame, names: list[str], alias: str = "attrs") -> DataFrame:
    return df.withColumn(alias, F.array(*feature_columns(names)))


def node_degrees(edges: DataFrame, keys: list[str], swapped: bool = False) -> DataFrame:
    """In and out degree of every node that has an edge in the graph; repeated edges count.

    ``swapped`` names them the other way round, as some trained models expect.
    """
    receiver, sender = ("src", "dst") if swapped else ("dst", "src")
    ends = F.array(
        F.struct(F.col(sender).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col(receiver).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    return edges.select(*keys, F.inline(ends)).groupBy(*keys, "node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree")
    )


def node_features(degrees: DataFrame, hosts: DataFrame, keys: list[str]) -> DataFrame:
    """Host flags plus degrees per (graph, node).

    Hosts without an edge have their flags and degree 0 in every graph, so that part of
    the hosts x bins product is left implicit.
    """
    flags = hosts.select("host_id", *[F.col(f).cast("int").alias(f) for f in HOST_FLAGS])
    return degrees.join(flags, degrees.node == flags.host_id).drop("host_id")


def idle_features(hosts: DataFrame) -> DataFrame:
    """Flags and degree 0 of every host, one row per host: what it has in each graph that it has no edge in.

    This stands for the part of the hosts x bins product that ``node_features`` leaves out.
    """
    zero = F.lit(0).cast("bigint")
    return hosts.select(
        F.col("host_id").alias("node"), *[F.col(f).cast("int").alias(f) for f in HOST_FLAGS],
        zero.alias("in_degree"), zero.alias("out_degree"),
    )


_MERGE = {
    "add": F.sum,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "mul": F.product,
}


def dedup_edges(edges: DataFrame, keys: list[str], attrs: list[str], reduce: str, tie: list[str] | None = None) -> DataFrame:
    """One row per (graph, src, dst); attributes merged by ``reduce``.

    "first" keeps the attributes of the earliest row in the order ``tie``.
    """
    if reduce == "first":
        merged = [F.min_by(F.struct(*attrs), F.struct(*tie)).alias("_first")]
        out = edges.groupBy(*keys, "src", "dst").agg(F.count("*").alias("copies"), *merged)
        return out.select(*keys, "src", "dst", "copies", "_first.*")
    if reduce not in _MERGE:
        raise ValueError(f"unknown merge {reduce!r}")
    merged = [_MERGE[reduce](a).alias(a) for a in attrs]
    return edges.groupBy(*keys, "src", "dst").agg(F.count("*").alias("copies"), *merged)


def remove_self_loops(edges: DataFrame, bipartite: bool = False) -> DataFrame:
    """Drop edges from a node to itself; ids of different node types never coincide."""
    return edges if bipartite else edges.filter(F.col("src") != F.col("dst"))


def hetero_edges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Host uses service, service communicates with service, service belongs to host.

    One pass: each event is unrolled into its three edges. Only the middle one has
    attributes.
    """
    empty = F.array().cast("array<double>")
    attrs = F.array(*feature_columns(HETERO_FEATURES))

    def edge(kind: str, src_type: str, src: str, dst_type: str, dst: str, features):
        return F.struct(
            F.lit(kind).alias("edge_type"),
            F.lit(src_type).alias("src_type"), F.col(src).alias("src"),
            F.lit(dst_type).alias("dst_type"), F.col(dst).alias("dst"),
            features.alias("attrs"),
        )

    unrolled = F.array(
        edge("uses", "host", "src", "service", "src_service_id", empty),
        edge("communicates_with", "service", "src_service_id", "service", "dest_service_id", attrs),
        edge("belongs_to", "service", "dest_service_id", "host", "dst", empty),
    )
    return df.select(*keys, "ts", "y", F.inline(unrolled))


def flatten_nodes(hosts: DataFrame, services: DataFrame, host_count: int) -> DataFrame:
    """Hosts and services as one node table: padded features, type code, ids that do not collide."""
    flags = [F.col(f).cast("int").cast("double") for f in HOST_FLAGS]
    width = len(flags)
    host_nodes = hosts.select(
        F.col("host_id").alias("node"), F.lit(0).alias("node_type"), F.array(*flags).alias("x")
    )
    own = F.array(F.col("port").cast("double"), F.col("is_known").cast("int").cast("double"))
    service_nodes = services.select(
        (F.col("service_id") + F.lit(host_count)).alias("node"), F.lit(1).alias("node_type"),
        F.concat(own, F.array_repeat(F.lit(0.0), width - 2)).alias("x"),
    )
    return host_nodes.unionByName(service_nodes)


EDGE_TYPES = ["uses", "communicates_with", "belongs_to"]


def flatten_edges(edges: DataFrame, host_count: int) -> DataFrame:
    """The same for edges: padded attributes, type code, shifted service ids."""
    width = len(HETERO_FEATURES)

    def shifted(side: str):
        return F.col(side) + F.when(F.col(f"{side}_type") == "service", F.lit(host_count)).otherwise(F.lit(0))

    pad = F.array_repeat(F.lit(0.0), width)
    return edges.withColumns({
        "src": shifted("src"),
        "dst": shifted("dst"),
        "attrs": F.slice(F.concat(F.col("attrs"), pad), 1, width),
        "edge_type_code": dictionary_code(F.col("edge_type"), EDGE_TYPES),
    })


def stride(population: int) -> int:
    """First number from the golden section of ``population`` upwards that is coprime to it."""
    step = population * 618033989 // 1000000000
    while math.gcd(step, population) != 1:
        step += 1
    return step


def negative_edges(
    edges: DataFrame, node_count: int, keys: list[str], minimum: int = 0, seed: int = 42, block: int = BLOCK
) -> DataFrame:
    """Distinct node pairs that are no edges, per graph as many as it has edges.

    Pairs without self loops are numbered 0..P-1. Candidate i of a graph is
    ``(start + i * stride) mod P``: all different, so no distinct is needed. At most
    E candidates can be edges, E being the graph's distinct edges, so the first n + E
    candidates always hold n that are not: the result is whole, not a best effort.

    A graph with very many edges is no single group: candidates are made, checked and
    ranked in blocks of fixed length.
    """
    population = node_count * (node_count - 1)
    loop_free = F.col("src") != F.col("dst")
    distinct = stage(
        edges.groupBy(*keys, "src", "dst").agg(F.count("*").alias("copies")), "graph-pairs"
    )
    graphs = distinct.groupBy(*keys).agg(
        F.sum("copies").alias("_edges"), F.count_if(loop_free).alias("_pairs")
    )
    wanted = F.least(F.greatest(F.col("_edges"), F.lit(minimum)), F.lit(population) - F.col("_pairs"))
    sized = graphs.withColumn("_n", wanted).withColumn("_m", F.col("_n") + F.col("_pairs"))
    blocks = sized.filter("_n > 0").withColumn(
        "_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_m") - 1) / F.lit(block))))
    ).repartition(*keys, "_block")
    first = F.col("_block") * block
    last = F.least(first + (block - 1), F.col("_m") - 1)
    step = stride(population)
    # the product may pass 64 bits
    wide = "decimal(38,0)"
    # modulo first, so that the start is below the population
    start = F.pmod(md5_int(seeded(seed, *keys), 15), F.lit(population))
    code = F.pmod(
        start.cast(wide) + F.col("_i").cast(wide) * F.lit(step).cast(wide), F.lit(population).cast(wide)
    ).cast("bigint")
    candidates = (
        blocks.withColumn("_i", F.explode(F.sequence(first, last)))
        .withColumn("_code", code)
        .withColumn("src", F.expr(f"_code div {node_count - 1}"))
        .withColumn("_r", F.col("_code") - F.col("src") * (node_count - 1))
        .withColumn("dst", F.col("_r") + F.when(F.col("_r") >= F.col("src"), 1).otherwise(0))
        .select(*keys, "_block", "_i", "_n", "src", "dst")
    )
    free = stage(candidates.join(distinct.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti"), "non-edges")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = free.groupBy(*keys, "_block").agg(F.count("*").alias("_c")).select(
        *keys, "_block", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_i")
    ranked = free.join(starts, [*keys, "_block"]).withColumn("draw", F.col("_s") + F.row_number().over(inside))
    return ranked.filter(F.col("draw") <= F.col("_n")).select(*keys, "draw", "src", "dst")


def training_pairs(positives: DataFrame, negatives: DataFrame, keys: list[str], variant: str = "benign") -> DataFrame:
    """Observed edges and sampled non-edges with link and class targets.

    ``variant="benign"``: the link target is 1 only for observed benign edges.
    ``variant="observed"``: it is 1 for every observed edge.
    """
    link = (F.col("y") == 0).cast("int") if variant == "benign" else F.lit(1)
    seen = positives.select(*keys, "src", "dst", F.lit(1).alias("observed"), link.alias("link_target"), F.col("y").alias("class_target"))
    drawn = negatives.select(
        *keys, "src", "dst", F.lit(0).alias("observed"), F.lit(0).alias("link_target"), F.lit(0).alias("class_target")
    )
    return seen.unionByName(drawn)


def graph_stats(edges: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """Edges and active nodes of every graph, empty graphs included."""
    sizes = edges.groupBy(*keys).agg(F.count("*").alias("edges"))
    active = (
        edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
        .groupBy(*keys).agg(F.count("*").alias("active_nodes"))
    )
    return spine.join(sizes, keys, "left").join(active, keys, "left").na.fill(0, ["edges", "active_nodes"])


def topology_slice(conn: DataFrame, hosts: DataFrame, lo, hi, ts: str = "ts") -> DataFrame:
    """Distinct edges of the events strictly inside a time slice, by host id."""
    from chronomesh.operators.dims import encode_hosts

    cut = conn.filter((F.col(ts) > F.lit(lo)) & (F.col(ts) < F.lit(hi)))
    # distinct before the lookup: the joins then see one row per pair
    pairs = cut.select("src_ip", "dest_ip").distinct()
    return encode_hosts(pairs, hosts).select(F.col("src").alias("source"), F.col("dst").alias("target"))
