"""One forward pass over whole snapshots: convolution, recurrence, pair scores, losses.

Every host takes part in every graph. Hosts without an edge in a graph are not listed there: their vectors do
not depend on the graph, so one row per host stands for all of them, in the convolution, in the
timelines and in the look-up of a pair's ends. The check SQL goes the long way, over all hosts x bins.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronomesh.functions.linear import weight_matrix, weight_vector
from chronomesh.operators import dims, graph, metrics, propagate, score, sequence
from chronomesh.plans import inputs, models
from chronomesh.plans.graphs import _KEYS_SQL
from chronomesh.plans.inputs import BATCH_KEYS, KEYS, shared, whole
from chronomesh.plans.models import B, HIDDEN, NODE_X, RNN, WIDTH, WINDOW
from chronomesh.plans.registry import part, query
from chronomesh.sources import schemas

CLASSES, MLP = len(schemas.LABEL_TACTIC), 5
GRU = models.example_recurrent(HIDDEN, RNN, 3)[0]
FIRST, FIRST_BIAS, SECOND, SECOND_BIAS = weight_matrix(MLP, 2 * RNN, 81), weight_vector(MLP, 82), weight_vector(MLP, 83), 0.05
CLASS_FIRST, CLASS_FIRST_BIAS = weight_matrix(MLP, 2 * RNN + 1, 84), weight_vector(MLP, 85)
CLASS_SECOND, CLASS_SECOND_BIAS = weight_matrix(CLASSES, MLP, 86), weight_vector(CLASSES, 87)

_X = [f"x{i}" for i in range(HIDDEN)]
part("idle_nodes", "SELECT host_id AS node, " + ", ".join(f"CAST({f} AS BIGINT) AS {f}" for f in graph.HOST_FLAGS) + ", CAST(0 AS BIGINT) AS in_degree, CAST(0 AS BIGINT) AS out_degree FROM flags")
part("every_x", "SELECT s.file_id, s.batch, s.bin, i.node, " + ", ".join(
    f"CAST({f'coalesce(d.{c}, 0)' if c.endswith('degree') else f'i.{c}'} AS DOUBLE) AS x{n}" for n, c in enumerate(NODE_X)
) + """ FROM spine s CROSS JOIN idle_nodes i
LEFT JOIN degrees d ON d.file_id = s.file_id AND d.batch = s.batch AND d.bin = s.bin AND d.node = i.node""")
models.gcn_parts("every", "every_x")
_V = [f"v{i}" for i in range(HIDDEN)]
_STATE = [f"h{i}" for i in range(RNN)]
part("every_lines", "SELECT file_id, batch, node, " + ", ".join(f"list({x} ORDER BY bin) AS l{i}" for i, x in enumerate(_X)) + " FROM every_round3 GROUP BY ALL")
part("every_state", f"""
SELECT file_id, batch, node, target AS bin, {', '.join(_STATE)} FROM (WITH RECURSIVE steps AS (
  SELECT file_id, batch, node, target, {', '.join(f'l{i}' for i in range(HIDDEN))}, 0 AS t, {', '.join(f'CAST(0 AS DOUBLE) AS {h}' for h in _STATE)}
  FROM every_lines, (SELECT CAST(unnest(range({WINDOW}, {B})) AS BIGINT) AS target)
  UNION ALL
  SELECT file_id, batch, node, target, {', '.join(f'l{i}' for i in range(HIDDEN))}, t + 1, {', '.join(models.gru_step_sql(GRU, _V, _STATE))}
  FROM (SELECT *, {', '.join(f'l{i}[target - {WINDOW} + t + 1] AS v{i}' for i in range(HIDDEN))} FROM steps WHERE t < {WINDOW})
) SELECT * FROM steps WHERE t = {WINDOW})
""")
_Z = [*(f"s.{h}" for h in _STATE), *(f"d.{h}" for h in _STATE)]
_HID = [f"greatest({models._dot_sql(_Z, r)} + {float(b)!r}, 0)" for r, b in zip(FIRST, FIRST_BIAS)]
part("every_pairs", f"""
SELECT file_id, batch, bin, src, dst, 1 AS observed, CASE WHEN y = 0 THEN 1 ELSE 0 END AS link_target, y AS class_target FROM positives
UNION ALL SELECT file_id, batch, bin, src, dst, 0, 0, 0 FROM negatives
""")
part("every_linked", f"SELECT p.*, {', '.join(f'{z} AS z{i}' for i, z in enumerate(_Z))}, {models._dot_sql(_HID, SECOND)} + {SECOND_BIAS} AS link_logit" + """
FROM every_pairs p JOIN every_state s ON s.file_id = p.file_id AND s.batch = p.batch AND s.bin = p.bin AND s.node = p.src
JOIN every_state d ON d.file_id = p.file_id AND d.batch = p.batch AND d.bin = p.bin AND d.node = p.dst""")
_CHID = [
    f"greatest({models._dot_sql([f'z{i}' for i in range(2 * RNN)], r[:-1])} + {float(r[-1])!r} / (1 + exp(-link_logit)) + {float(b)!r}, 0)"
    for r, b in zip(CLASS_FIRST, CLASS_FIRST_BIAS)
]
part("every_hidden", "SELECT *, " + ", ".join(f"{v} AS q{i}" for i, v in enumerate(_CHID)) + " FROM every_linked")
part("every_scored", "SELECT *, " + ", ".join(
    f"{models._dot_sql([f'q{i}' for i in range(MLP)], r)} + {float(b)!r} AS c{k}" for k, (r, b) in enumerate(zip(CLASS_SECOND, CLASS_SECOND_BIAS))
) + " FROM every_hidden")


def _idle(spark, sf_dir):
    return graph.idle_features(dims.enrich_hosts(inputs.hosts(spark, sf_dir)))


def _idle_x(idle):
    return idle.select("node", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(NODE_X)])


@query("idle_host_features", "SELECT * FROM idle_nodes")
def idle_host_features(spark, sf_dir):
    return whole(_idle(spark, sf_dir), *graph.HOST_FLAGS)


@query("gcn_idle", "SELECT DISTINCT node, " + ", ".join(f"round({x}, 5) AS {x}" for x in _X) + """
FROM every_round3 e WHERE NOT EXISTS (SELECT 1 FROM degrees d WHERE d.file_id = e.file_id AND d.batch = e.batch AND d.bin = e.bin AND d.node = e.node)
""")
def gcn_idle(spark, sf_dir):
    """The same row comes out of the full product in every graph that the host is silent in."""
    out = propagate.gcn_idle(_idle_x(_idle(spark, sf_dir)), WIDTH, models.GCN_LAYERS)
    return out.select("node", *[F.round(x, 5).alias(x) for x in _X])


def forward(spark, sf_dir):
    """Training pairs with link and class logits."""
    hosts = shared(dims.enrich_hosts(inputs.hosts(spark, sf_dir)), "hosts")
    edges = shared(inputs.edges(spark, sf_dir, hosts.select("host_id", "host")).select(*KEYS, "conn_id", "piece", "src", "dst", "y"), "edges")
    nodes = graph.node_features(graph.node_degrees(edges, KEYS), hosts, KEYS)
    vectors = nodes.select(*KEYS, "node", *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(NODE_X)])
    active = propagate.gcn_propagate(vectors, edges, KEYS, WIDTH, models.GCN_LAYERS)
    idle = shared(propagate.gcn_idle(_idle_x(graph.idle_features(hosts)), WIDTH, models.GCN_LAYERS), "idle")
    positives = sequence.positive_edges(edges, WINDOW)
    pairs = shared(graph.training_pairs(positives, graph.negative_edges(positives, hosts.count(), KEYS), KEYS), "pairs")
    states, idle_states = propagate.end_states(active, idle, pairs, BATCH_KEYS, B, WINDOW, HIDDEN, [GRU])
    placed = score.with_pair_vectors(pairs, shared(states, "states"), shared(idle_states, "idle-states"), KEYS)
    return score.pair_scores(
        placed, RNN, FIRST, FIRST_BIAS, SECOND, SECOND_BIAS, CLASS_FIRST, CLASS_FIRST_BIAS, CLASS_SECOND, CLASS_SECOND_BIAS
    )


@query("forward_link_scores", f"SELECT {_KEYS_SQL}, src, dst, CAST(observed AS BIGINT) AS observed, CAST(link_target AS BIGINT) AS link_target, class_target, round(link_logit, 4) AS link_logit, "
       + ", ".join(f"round(c{k}, 4) AS c{k}" for k in range(CLASSES)) + " FROM every_scored")
def forward_link_scores(spark, sf_dir):
    """As many rows as there are training pairs."""
    out = forward(spark, sf_dir).select(
        *KEYS, "src", "dst", "observed", "link_target", "class_target", F.round("link_logit", 4).alias("link_logit"),
        *[F.round(F.element_at("class_logits", k + 1), 4).alias(f"c{k}") for k in range(CLASSES)],
    )
    return whole(out, "file_id", "bin", "observed", "link_target", "class_target")


_LOGITS = "[" + ", ".join(f"c{k}" for k in range(CLASSES)) + "]"


@query("forward_losses", f"""
SELECT CAST(file_id AS BIGINT) AS file_id, batch, round(pred_loss, 4) AS pred_loss, round(class_loss, 4) AS class_loss,
       round(confidence_loss, 4) AS confidence_loss, round(pred_loss * 1.2 + class_loss, 4) AS loss_alpha
FROM (SELECT file_id, batch, avg(greatest(link_logit, 0) - link_logit * link_target + ln(1 + exp(-abs(link_logit)))) AS pred_loss,
             sum(w * ce) / sum(w) AS class_loss, avg(ce / (1 + exp(-link_logit))) AS confidence_loss
      FROM (SELECT *, CASE WHEN class_target = 0 THEN 1.0 ELSE 5.0 END::DOUBLE AS w,
                   ln(list_sum(list_transform({_LOGITS}, lambda v: exp(v)))) - {_LOGITS}[class_target + 1] AS ce FROM every_scored)
      GROUP BY file_id, batch)
""")
def forward_losses(spark, sf_dir):
    losses = metrics.combined_losses(forward(spark, sf_dir), BATCH_KEYS, "class_logits", "class_target", "link_logit", "link_target")
    names = ("pred_loss", "class_loss", "confidence_loss", "loss_alpha")
    return whole(losses.select(*BATCH_KEYS, *[F.round(n, 4).alias(n) for n in names]), "file_id")
