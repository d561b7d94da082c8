"""Forward passes of the attention family and of the typed family: rounds, recurrence, bilinear scores.

Both score every edge after the warm-up and at least 20 drawn pairs per graph. Nodes without an edge in a graph are not
listed there; one row per node stands for all of them. The check SQL goes the long way, over all nodes x bins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.functions.linear import weight_matrix, weight_vector
from chronomesh.operators import dims, graph, propagate, score, sequence
from chronomesh.plans import forward, graphs, inputs, models
from chronomesh.plans.inputs import BATCH_KEYS, KEYS, shared, whole
from chronomesh.plans.models import ATTENTION, B, EDGE_ATTRS, HIDDEN, NODE_X, RNN, TYPED, TYPED_ATTRS, WIDTH, WINDOW
from chronomesh.plans.registry import part, query
from chronomesh.sources import schemas, views

CLASSES, MLP, LEAST_NEGATIVES = len(schemas.LABEL_TACTIC), 5, 20
TYPED_WIDTH = len(graph.HOST_FLAGS)
ATTENTION_LAYERS = [ATTENTION, propagate.AttentionWeights(
    source=weight_matrix(HIDDEN, HIDDEN, 101), source_bias=weight_vector(HIDDEN, 102),
    target=weight_matrix(HIDDEN, HIDDEN, 103), target_bias=weight_vector(HIDDEN, 104),
    edge=weight_matrix(HIDDEN, len(EDGE_ATTRS), 105), score=[0.2, 0.15, -0.3, 0.1], bias=weight_vector(HIDDEN, 106),
)]
TYPED_LAYERS = [TYPED, propagate.TypedWeights(
    node=[weight_matrix(HIDDEN, HIDDEN, 111), weight_matrix(HIDDEN, HIDDEN, 112)],
    node_bias=[weight_vector(HIDDEN, 113), weight_vector(HIDDEN, 114)],
    edge_type=weight_matrix(3, 2, 115), attr=weight_matrix(3, len(TYPED_ATTRS), 116),
    score=weight_vector(2 * HIDDEN + 2 + 3, 117), out=weight_matrix(HIDDEN, HIDDEN + 3, 118), out_bias=weight_vector(HIDDEN, 119),
)]
LSTM = models.example_recurrent(HIDDEN, RNN, 4)[0]
BILINEAR, BILINEAR_BIAS = weight_matrix(RNN, RNN, 121), 0.05
CLASS_FIRST, CLASS_FIRST_BIAS = weight_matrix(MLP, 2 * RNN, 122), weight_vector(MLP, 123)
CLASS_SECOND, CLASS_SECOND_BIAS = weight_matrix(CLASSES, MLP, 124), weight_vector(CLASSES, 125)

_xs, _dot, _project, _leaky, _norm = models._xs, models._dot_sql, models._project_sql, models._leaky_sql, models._norm_sql
_X, _H, _C = _xs(HIDDEN), _xs(RNN, "h"), _xs(RNN, "c")


def _same(a: str, b: str, node: str, column: str = "node") -> str:
    return f"{b}.file_id = {a}.file_id AND {b}.batch = {a}.batch AND {b}.bin = {a}.bin AND {b}.{column} = {a}.{node}"


def _normed(columns: list[str], last: bool) -> str:
    return ", ".join(f"{v if last else f'greatest({v}, 0)'} AS x{i}" for i, v in enumerate(_norm(columns)))


def attention_parts(prefix: str, nodes: str, layers: list[propagate.AttentionWeights]) -> str:
    """Check SQL of attention rounds over the rows of ``nodes``; the name of the result."""
    part(f"{prefix}_looped", f"""
SELECT * FROM att_edges WHERE src <> dst
UNION ALL SELECT n.file_id, n.batch, n.bin, n.node, n.node, {', '.join(f'coalesce(avg({a}), 0)' for a in EDGE_ATTRS)}
FROM {nodes} n LEFT JOIN (SELECT * FROM att_edges WHERE src <> dst) e ON {_same('n', 'e', 'node', 'dst')} GROUP BY n.file_id, n.batch, n.bin, n.node
""")
    width = WIDTH
    for k, w in enumerate(layers):
        left = _project([f"s.{x}" for x in _xs(width)], w.source, w.source_bias)
        right = _project([f"t.{x}" for x in _xs(width)], w.target, w.target_bias)
        mixed = [_leaky(f"({a} + {b} + {e})") for a, b, e in zip(left, right, _project([f"e.{a}" for a in EDGE_ATTRS], w.edge))]
        size = len(w.source)
        part(f"{prefix}_scored{k}", f"SELECT e.file_id, e.batch, e.bin, e.src, e.dst, {_dot(mixed, w.score)} AS s, "
             + ", ".join(f"{v} AS l{i}" for i, v in enumerate(left))
             + f" FROM {prefix}_looped e JOIN {nodes} s ON {_same('e', 's', 'src')} JOIN {nodes} t ON {_same('e', 't', 'dst')}")
        part(f"{prefix}_sums{k}", "SELECT file_id, batch, bin, dst AS node, " + ", ".join(
            f"sum(exp(s - top) * l{i}) / sum(exp(s - top)) + CAST({float(b)!r} AS DOUBLE) AS y{i}" for i, b in enumerate(w.bias)
        ) + f" FROM (SELECT *, max(s) OVER (PARTITION BY file_id, batch, bin, dst) AS top FROM {prefix}_scored{k}) GROUP BY ALL")
        part(f"{prefix}_out{k}", f"SELECT file_id, batch, bin, node, {_normed(_xs(size, 'y'), k == len(layers) - 1)} FROM {prefix}_sums{k}")
        nodes, width = f"{prefix}_out{k}", size
    return nodes


def typed_parts(prefix: str, nodes: str, layers: list[propagate.TypedWeights]) -> str:
    """The same for typed rounds; ``nodes`` has a node_type."""
    width = TYPED_WIDTH
    for k, w in enumerate(layers):
        size, kinds, attrs = len(w.node[0]), len(w.edge_type[0]), len(w.attr)
        h, e = _xs(size, "h"), _xs(attrs, "e")
        both = zip(*[_project(_xs(width), m, b) for m, b in zip(w.node, w.node_bias)])
        part(f"{prefix}_own{k}", "SELECT file_id, batch, bin, node, node_type, "
             + ", ".join(f"CASE WHEN node_type = 0 THEN {a} ELSE {b} END AS {n}" for (a, b), n in zip(both, h)) + f" FROM {nodes}")
        embedded = [_leaky(v) for v in _project([f"e.{a}" for a in TYPED_ATTRS], w.attr)]
        by_type = w.score[2 * size:2 * size + kinds]
        case = "CASE kind " + " ".join(
            f"WHEN {i} THEN CAST({sum((v if v >= 0 else 0.2 * v) * s for v, s in zip(row, by_type))!r} AS DOUBLE)" for i, row in enumerate(w.edge_type)) + " END"
        raw = " + ".join([_dot([f"t.{x}" for x in h], w.score[:size]), _dot([f"s.{x}" for x in h], w.score[size:2 * size]),
                          case, _dot(embedded, w.score[2 * size + kinds:])])
        part(f"{prefix}_raw{k}", f"SELECT e.file_id, e.batch, e.bin, e.dst, {raw} AS r, {', '.join(f's.{x} AS {x}' for x in h)}, "
             + ", ".join(f"{v} AS {n}" for v, n in zip(embedded, e))
             + f" FROM typed_flat e JOIN {prefix}_own{k} s ON {_same('e', 's', 'src')} JOIN {prefix}_own{k} t ON {_same('e', 't', 'dst')}")
        part(f"{prefix}_sums{k}", "SELECT file_id, batch, bin, dst AS node, "
             + ", ".join(f"sum(exp(s - top) * {c}) / sum(exp(s - top)) AS {c}" for c in h + e)
             + f" FROM (SELECT *, max(s) OVER (PARTITION BY file_id, batch, bin, dst) AS top FROM (SELECT *, {_leaky('r')} AS s FROM {prefix}_raw{k})) GROUP BY ALL")
        part(f"{prefix}_mapped{k}", "SELECT n.file_id, n.batch, n.bin, n.node, n.node_type, " + ", ".join(
            f"coalesce({v}, 0) AS y{i}" for i, v in enumerate(_project([f"m.{c}" for c in h + e], w.out, w.out_bias)))
            + f" FROM {nodes} n LEFT JOIN {prefix}_sums{k} m ON {_same('n', 'm', 'node')}")
        width = len(w.out)
        part(f"{prefix}_out{k}", f"SELECT file_id, batch, bin, node, node_type, {_normed(_xs(width, 'y'), k == len(layers) - 1)} FROM {prefix}_mapped{k}")
        nodes = f"{prefix}_out{k}"
    return nodes


def score_parts(prefix: str, vectors: str, positives: str, negatives: str) -> str:
    """Check SQL from the nodes' vectors in every bin to the pairs' scores; the name of the result."""
    lists = ", ".join(f"l{i}" for i in range(HIDDEN))
    part(f"{prefix}_lines", f"SELECT file_id, batch, node, {', '.join(f'list({x} ORDER BY bin) AS l{i}' for i, x in enumerate(_X))} FROM {vectors} GROUP BY file_id, batch, node")
    cells, gates = models.lstm_step_sql(LSTM, _xs(HIDDEN, "v"), _H, _C)
    step = f"SELECT *, {', '.join(f'l{i}[target - {WINDOW} + t + 1] AS v{i}' for i in range(HIDDEN))} FROM steps WHERE t < {WINDOW}"
    step = f"SELECT * REPLACE ({', '.join(f'{v} AS {c}' for v, c in zip(cells, _C))}), {', '.join(f'{v} AS g{i}' for i, v in enumerate(gates))} FROM ({step})"
    part(f"{prefix}_state", f"""
SELECT file_id, batch, node, target AS bin, {', '.join(_H)} FROM (WITH RECURSIVE steps AS (
  SELECT file_id, batch, node, target, {lists}, 0 AS t, {', '.join(f'CAST(0 AS DOUBLE) AS {x}' for x in _H + _C)}
  FROM {prefix}_lines, (SELECT CAST(unnest(range({WINDOW}, {B})) AS BIGINT) AS target)
  UNION ALL
  SELECT file_id, batch, node, target, {lists}, t + 1, {', '.join(f'g{i} * {models._tanh_sql(c)}' for i, c in enumerate(_C))}, {', '.join(_C)} FROM ({step})
) SELECT * FROM steps WHERE t = {WINDOW})
""")
    z = [*(f"s.{h}" for h in _H), *(f"d.{h}" for h in _H)]
    link = " + ".join(f"s.{h} * {_dot([f'd.{x}' for x in _H], row)}" for h, row in zip(_H, BILINEAR)) + f" + {BILINEAR_BIAS}"
    inner = [f"greatest({_dot(z, row)} + CAST({float(b)!r} AS DOUBLE), 0)" for row, b in zip(CLASS_FIRST, CLASS_FIRST_BIAS)]
    part(f"{prefix}_linked", f"""
SELECT p.*, {link} AS link_logit, {', '.join(f'{v} AS q{i}' for i, v in enumerate(inner))} FROM (
  SELECT file_id, batch, bin, src, dst, 1 AS observed, y AS class_target FROM {positives} UNION ALL SELECT file_id, batch, bin, src, dst, 0, 0 FROM {negatives}
) p JOIN {prefix}_state s ON {_same('p', 's', 'src')} JOIN {prefix}_state d ON {_same('p', 'd', 'dst')}
""")
    part(f"{prefix}_classed", "SELECT *, " + ", ".join(
        f"{_dot(_xs(MLP, 'q'), row)} + CAST({float(b)!r} AS DOUBLE) AS k{i}" for i, (row, b) in enumerate(zip(CLASS_SECOND, CLASS_SECOND_BIAS))
    ) + f" FROM {prefix}_linked")
    return f"{prefix}_classed"


part("full_attention_x", "SELECT * FROM every_x")
_ATTENTION_OUT = attention_parts("full_attention", "full_attention_x", ATTENTION_LAYERS)
part("least_negatives", graphs.negatives_sql(LEAST_NEGATIVES))
_ATTENTION_SCORES = score_parts("attended", _ATTENTION_OUT, "positives", "least_negatives")

part("full_typed_x", "SELECT file_id, batch, bin, k.* FROM spine CROSS JOIN typed_known k")
_TYPED_OUT = typed_parts("full_typed", "full_typed_x", TYPED_LAYERS)
part("typed_positives", " UNION ALL ".join(
    f"SELECT file_id, batch, bin, {src} AS src, {dst} AS dst, y FROM typed, host_total WHERE bin >= {WINDOW}"
    for src, dst in (("src", "ssv + n"), ("ssv + n", "dsv + n"), ("dsv + n", "dst"))))
part("typed_population", graphs.population_sql("SELECT count(*) AS n FROM typed_known"))
part("typed_negatives", graphs.negatives_sql(LEAST_NEGATIVES, "typed_positives", "typed_population"))
_TYPED_SCORES = score_parts("typed_pair", _TYPED_OUT, "typed_positives", "typed_negatives")


def _idle_sql(vectors: str, active: str) -> str:
    return "SELECT DISTINCT node, " + ", ".join(f"round({x}, 5) AS {x}" for x in _X) + f" FROM {vectors} v WHERE NOT EXISTS (SELECT 1 FROM {active} a WHERE {_same('v', 'a', 'node')})"


def _scores_sql(scores: str) -> str:
    return (f"SELECT {models._KEYS_SQL}, src, dst, CAST(observed AS BIGINT) AS observed, class_target, round(link_logit, 4) AS link_logit, "
            + ", ".join(f"round(k{i}, 4) AS c{i}" for i in range(CLASSES)) + f" FROM {scores}")


part("typed_active", "SELECT file_id, batch, bin, src AS node FROM typed_flat UNION SELECT file_id, batch, bin, dst FROM typed_flat")


def _rounded(idle):
    return idle.select("node", *[F.round(x, 5).alias(x) for x in _X])


@query("attention_idle", _idle_sql(_ATTENTION_OUT, "degrees"))
def attention_idle(spark, sf_dir):
    """The same row comes out of the full product in every graph that the host is silent in."""
    idle = forward._idle_x(graph.idle_features(dims.enrich_hosts(inputs.hosts(spark, sf_dir))))
    return _rounded(propagate.attention_idle(idle, WIDTH, ATTENTION_LAYERS))


def _typed_known(spark, sf_dir):
    """Hosts, services, and the features of both in one numbering."""
    conn = views.conn(spark, sf_dir)
    hosts, services = shared(dims.host_map(conn), "hosts"), shared(dims.service_map(conn), "services")
    count = hosts.count()
    known = graph.flatten_nodes(dims.enrich_hosts(hosts), dims.enrich_services(services), count)
    return hosts, services, count, shared(models.typed_features(known), "typed-known")


@query("typed_idle", _idle_sql(_TYPED_OUT, "typed_active"))
def typed_idle(spark, sf_dir):
    """Hosts and services alike receive nothing in a graph that they are silent in."""
    *_, known = _typed_known(spark, sf_dir)
    return _rounded(propagate.typed_idle(known, TYPED_WIDTH, TYPED_LAYERS))


def _scores(pairs, active, idle):
    """Recurrence over the named nodes' timelines, then link and class scores of every pair."""
    states, idle_states = propagate.end_states(active, idle, pairs, BATCH_KEYS, B, WINDOW, HIDDEN, [LSTM], "lstm")
    placed = score.with_pair_vectors(pairs, shared(states, "states"), shared(idle_states, "idle-states"), KEYS)
    return score.pair_bilinear_scores(placed, BILINEAR, BILINEAR_BIAS, CLASS_FIRST, CLASS_FIRST_BIAS, CLASS_SECOND, CLASS_SECOND_BIAS)


def attention_forward(spark, sf_dir):
    hosts = shared(dims.enrich_hosts(inputs.hosts(spark, sf_dir)), "hosts")
    columns = [c.alias(a) for a, c in graphs.scaled_columns(EDGE_ATTRS).items()]
    edges = shared(inputs.edges(spark, sf_dir, hosts.select("host_id", "host")).select(*KEYS, "src", "dst", "y", *columns), "edges")
    nodes = graph.node_features(graph.node_degrees(edges, KEYS), hosts, KEYS)
    vectors = nodes.select(*KEYS, "node", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(NODE_X)])
    active = propagate.attention_propagate(vectors, edges, KEYS, WIDTH, EDGE_ATTRS, ATTENTION_LAYERS)
    idle = shared(propagate.attention_idle(forward._idle_x(graph.idle_features(hosts)), WIDTH, ATTENTION_LAYERS), "idle")
    positives = sequence.positive_edges(edges, WINDOW)
    negatives = graph.negative_edges(positives, hosts.count(), KEYS, minimum=LEAST_NEGATIVES)
    return _scores(shared(graph.training_pairs(positives, negatives, KEYS, "observed"), "pairs"), active, idle)


def typed_forward(spark, sf_dir):
    hosts, services, count, known = _typed_known(spark, sf_dir)
    flat = graph.flatten_edges(graph.hetero_edges(inputs.hetero_input(spark, sf_dir, hosts, services), KEYS), count)
    edges = shared(models.typed_edge_inputs(flat, "y"), "typed-edges")
    nodes = edges.select(*KEYS, F.explode(F.array("src", "dst")).alias("node")).distinct().join(known, "node")
    active = propagate.typed_propagate(nodes, edges, KEYS, TYPED_WIDTH, TYPED_ATTRS, TYPED_LAYERS)
    idle = shared(propagate.typed_idle(known, TYPED_WIDTH, TYPED_LAYERS), "idle")
    positives = sequence.positive_edges(edges, WINDOW)
    negatives = graph.negative_edges(positives, known.count(), KEYS, minimum=LEAST_NEGATIVES)
    return _scores(shared(graph.training_pairs(positives, negatives, KEYS, "observed"), "pairs"), active, idle)


def _reported(scores):
    out = scores.select(
        *KEYS, "src", "dst", "observed", "class_target", F.round("link_logit", 4).alias("link_logit"),
        *[F.round(F.element_at("class_logits", i + 1), 4).alias(f"c{i}") for i in range(CLASSES)])
    return whole(out, "file_id", "bin", "observed", "class_target")


@query("forward_attention_scores", _scores_sql(_ATTENTION_SCORES))
def forward_attention_scores(spark, sf_dir):
    """Attention rounds with edge attributes, one LSTM layer, bilinear links: as many rows as pairs."""
    return _reported(attention_forward(spark, sf_dir))


@query("forward_hetero_scores", _scores_sql(_TYPED_SCORES))
def forward_hetero_scores(spark, sf_dir):
    """Typed rounds over hosts and services, one LSTM layer, bilinear links: as many rows as pairs."""
    return _reported(typed_forward(spark, sf_dir))
