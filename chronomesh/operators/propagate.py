"""Message passing over graph snapshots, and recurrent encoding of node sequences.

Weights are given inputs. A node is keyed by (graph keys, node), so messages of one busy
host spread over its bins, and every sum at the destination combines on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.functions.linear import Matrix, dot, layer_norm, leaky_relu, project, relu
from chronomesh.operators import sequence
from chronomesh.operators.scaling import stage


#: Timelines that a worker encodes together; it bounds memory and changes no result.
BLOCK_ROWS = 512


def vector_names(prefix: str, size: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(size)]


def _prefixed(df: DataFrame, keys: list[str], node: str, columns: list, names: list[str]) -> DataFrame:
    return df.select(*keys, F.col("node").alias(node), *[c.alias(n) for c, n in zip(columns, names)])


def gcn_pairs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pairs of the convolution without self loops; repeated edges become a multiplicity ``w``, which bounds a host's rows by its distinct peers."""
    return stage(edges.filter("src <> dst").groupBy(*keys, "src", "dst").agg(F.count("*").cast("double").alias("w")), "gcn-pairs")


def gcn_layer(
    nodes: DataFrame, adjacency: DataFrame, keys: list[str], width: int, weight: Matrix, bias: list[float], activate: bool, heard: DataFrame
) -> DataFrame:
    """One round: transform at the node, send along the edges, sum at the destination.

    ``nodes`` carries its in-degree ``d``. Half of the normalisation is applied by the
    sender and half by the receiver, whose degree is the sum of the weights it receives,
    so no degree is looked up per edge. ``heard`` has sums (keys, node, w, _h0..) received from elsewhere.
    """
    names = vector_names("_h", len(weight))
    values = project([F.col(c) for c in vector_names("x", width)], weight)
    sent = _prefixed(nodes, keys, "src", [v / F.sqrt("d") for v in values], names)
    moved = adjacency.join(sent, ["src", *keys]).select(*keys, F.col("dst").alias("node"), "w", *[(F.col("w") * F.col(n)).alias(n) for n in names])
    summed = moved.unionByName(heard).groupBy(*keys, "node").agg(F.sum("w").alias("d"), *[F.sum(n).alias(n) for n in names])
    received = [F.col(n) / F.sqrt("d") + F.lit(float(b)) for n, b in zip(names, bias)]
    return summed.select(*keys, "node", "d", *[(relu(v) if activate else v).alias(f"x{i}") for i, v in enumerate(received)])


def _gcn_alone(nodes: DataFrame, width: int, layers: list[tuple[Matrix, list[float]]]) -> DataFrame:
    """Add what nodes that receive nothing send in round ``t``, ``_m{t}_0..``, and their state after the last round, ``_s0..``.

    Such a node has only its self loop of weight one, so each round is the transform and the bias.
    """
    state = [F.col(c) for c in vector_names("x", width)]
    for t, (weight, bias) in enumerate(layers):
        sent = vector_names(f"_m{t}_", len(weight))
        nodes = nodes.withColumns(dict(zip(sent, project(state, weight))))
        state = [F.col(m) + F.lit(float(b)) for m, b in zip(sent, bias)]
        state = [relu(v) for v in state] if t < len(layers) - 1 else state
    return nodes.withColumns({f"_s{i}": v for i, v in enumerate(state)})


def gcn_states(
    nodes: DataFrame, edges: DataFrame, keys: list[str], width: int, layers: list[tuple[Matrix, list[float]]], carried: list[str] | None = None
) -> DataFrame:
    """``gcn_propagate`` with the ``carried`` columns of ``nodes`` and ``d``, the weight a node receives, its own loop included.

    What a node that receives nothing sends in each round follows from its own features, so all its rounds go along its edges
    in one join. Only pairs whose sender receives something itself are joined anew in every round.
    """
    carried, first = carried or [], width
    node, size = [*keys, "node"], len(layers[-1][0])
    pairs = gcn_pairs(edges, keys)
    degree = stage(pairs.groupBy(*keys, F.col("dst").alias("node")).agg((F.sum("w") + F.lit(1.0)).alias("d")), "gcn-degree")
    known = stage(nodes.join(degree, ["node", *keys], "left").select(*node, *vector_names("x", width), *carried, "d"), "gcn-known")
    quiet, busy = known.filter("d IS NULL"), known.filter("d IS NOT NULL")

    sent = quiet.select(*keys, F.col("node").alias("src"), *vector_names("x", width))
    said = _gcn_alone(pairs.join(sent, ["src", *keys]), width, layers)
    messages = [m for t, (weight, _) in enumerate(layers) for m in vector_names(f"_m{t}_", len(weight))]
    heard = stage(said.groupBy(*keys, F.col("dst").alias("node")).agg(
        F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(m)).alias(m) for m in messages]
    ), "gcn-heard")

    senders = degree.select(*keys, F.col("node").alias("src"))
    loops = busy.select(*keys, F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    adjacency = stage(pairs.join(senders, ["src", *keys], "left_semi").select(*keys, "src", "dst", "w").unionByName(loops), "gcn-adjacency")
    states = busy.drop(*carried)
    for t, (weight, bias) in enumerate(layers):
        own = heard.select(*node, "w", *[F.col(f"_m{t}_{i}").alias(f"_h{i}") for i in range(len(weight))])
        states = stage(gcn_layer(states, adjacency, keys, width, weight, bias, t < len(layers) - 1, own), "gcn-nodes")
        width = len(weight)
    if carried:
        states = stage(states.join(busy.select(*node, *carried), node), "gcn-nodes")
    alone = _gcn_alone(quiet, first, layers)
    return alone.select(*node, *carried, F.lit(1.0).alias("d"), *[F.col(f"_s{i}").alias(f"x{i}") for i in range(size)]).unionByName(
        states.select(*node, *carried, "d", *vector_names("x", size)))


def gcn_propagate(nodes: DataFrame, edges: DataFrame, keys: list[str], width: int, layers: list[tuple[Matrix, list[float]]]) -> DataFrame:
    """Graph convolution rounds with ReLU between them, none after the last.

    ``nodes`` lists every node that has an edge. The node table is staged between rounds:
    the plan does not grow, and each join has a plain scan on both sides, which is what
    AQE needs to split the partition of a hot sender.
    """
    return gcn_states(nodes, edges, keys, width, layers).drop("d")


def gcn_idle(idle: DataFrame, width: int, layers: list[tuple[Matrix, list[float]]]) -> DataFrame:
    """The convolution of nodes without edges, one row per node, valid in every graph that they are silent in.

    Such a node has only its self loop of weight one, so each round is the transform and the bias.
    """
    for i, (weight, bias) in enumerate(layers):
        values = [v + F.lit(float(b)) for v, b in zip(project([F.col(c) for c in vector_names("x", width)], weight), bias)]
        activate = i < len(layers) - 1
        idle = idle.select("node", *[(relu(v) if activate else v).alias(f"x{j}") for j, v in enumerate(values)])
        width = len(weight)
    return idle


@dataclass(frozen=True)
class AttentionWeights:
    """Weights of one attention layer: source, target and edge matrices, score vector, bias."""

    source: Matrix
    source_bias: list[float]
    target: Matrix
    target_bias: list[float]
    edge: Matrix
    score: list[float]
    bias: list[float]


def _finish(df: DataFrame, names: list[str], normalise: bool, activate: bool) -> DataFrame:
    if normalise:
        df = layer_norm(df, names)
    return df.withColumns({n: relu(F.col(n)) for n in names}) if activate else df


def with_mean_loops(edges: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """Replace self loops by one per node, whose attributes are the mean of its incoming edges."""
    plain = edges.select(*keys, "src", "dst", *attrs).filter("src <> dst")
    incoming = plain.select(*keys, F.col("dst").alias("node"), *attrs)
    # a row without attributes for each end, so that nodes with no incoming edge are listed too
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).select(
        *keys, "node", *[F.lit(None).cast("double").alias(a) for a in attrs]
    )
    loops = incoming.unionByName(ends).groupBy(*keys, "node").agg(
        *[F.coalesce(F.avg(a), F.lit(0.0)).alias(a) for a in attrs]
    )
    return plain.unionByName(loops.select(*keys, F.col("node").alias("src"), F.col("node").alias("dst"), *attrs))


def softmax_sums(scored: DataFrame, keys: list[str], score: str, values: list[str]) -> DataFrame:
    """Softmax-weighted sums of ``values`` over the edges into each node.

    Maximum first, then sums of exp(score - maximum): two aggregates with map-side
    combine, and no window that would hold all edges of a hot node in one task. The
    maxima are staged so that AQE can split the join back to a hot node's edges.
    """
    top = stage(scored.groupBy(*keys, "dst").agg(F.max(score).alias("_top")), "softmax-top")
    weight = F.exp(F.col(score) - F.col("_top"))
    sums = scored.join(top, [*keys, "dst"]).groupBy(*keys, "dst").agg(
        F.sum(weight).alias("_total"), *[F.sum(weight * F.col(v)).alias(v) for v in values]
    )
    return sums.select(*keys, F.col("dst").alias("node"), *[(F.col(v) / F.col("_total")).alias(v) for v in values])


def attention_layer(
    nodes: DataFrame, edges: DataFrame, keys: list[str], width: int, attrs: list[str], w: AttentionWeights,
    normalise: bool = True, activate: bool = False, slope: float = 0.2,
) -> DataFrame:
    """Attention over incoming edges, self loop included, then layer norm and ReLU if asked.

    Node-side products are made once per node; an edge only adds them up.
    """
    return _attend(nodes, with_mean_loops(edges, keys, attrs), keys, width, attrs, w, normalise, activate, slope)


def _attend(
    nodes: DataFrame, looped: DataFrame, keys: list[str], width: int, attrs: list[str], w: AttentionWeights,
    normalise: bool, activate: bool, slope: float,
) -> DataFrame:
    out = len(w.source)
    nodes = stage(nodes, "attention-nodes")
    x = [F.col(c) for c in vector_names("x", width)]
    left, right = vector_names("_l", out), vector_names("_r", out)
    source = _prefixed(nodes, keys, "src", project(x, w.source, w.source_bias), left)
    target = _prefixed(nodes, keys, "dst", project(x, w.target, w.target_bias), right)
    edge_part = project([F.col(a) for a in attrs], w.edge)
    mixed = [leaky_relu(F.col(a) + F.col(b) + e, slope) for a, b, e in zip(left, right, edge_part)]
    scored = stage(
        looped.join(source, [*keys, "src"]).join(target, [*keys, "dst"])
        .select(*keys, "src", "dst", dot(mixed, w.score).alias("_s"), *left),
        "attention-scores",
    )
    sums = softmax_sums(scored, keys, "_s", left)
    values = [F.col(n) + F.lit(float(b)) for n, b in zip(left, w.bias)]
    raw = sums.select(*keys, "node", *[v.alias(f"x{i}") for i, v in enumerate(values)])
    return _finish(raw, vector_names("x", out), normalise, activate)


def attention_propagate(
    nodes: DataFrame, edges: DataFrame, keys: list[str], width: int, attrs: list[str], layers: list[AttentionWeights], slope: float = 0.2
) -> DataFrame:
    """Attention rounds, each with layer norm, with ReLU between them and none after the last.

    ``nodes`` lists every node that has an edge. The loops and their mean attributes are made once for all rounds.
    """
    looped = stage(with_mean_loops(edges, keys, attrs), "attention-looped")
    for i, w in enumerate(layers):
        nodes = _attend(nodes, looped, keys, width, attrs, w, True, i < len(layers) - 1, slope)
        width = len(w.source)
    return nodes


def attention_idle(idle: DataFrame, width: int, layers: list[AttentionWeights]) -> DataFrame:
    """Attention rounds of nodes without edges, one row per node, valid in every graph that they are silent in.

    Such a node attends to its self loop only, with weight one whatever the score, so a round is the source's product,
    the bias and the layer norm; the loop's attributes, the mean of none, enter the score alone.
    """
    for i, w in enumerate(layers):
        values = [v + F.lit(float(b)) for v, b in zip(project([F.col(c) for c in vector_names("x", width)], w.source, w.source_bias), w.bias)]
        width = len(w.source)
        names = vector_names("x", width)
        idle = _finish(idle.select("node", *[v.alias(n) for v, n in zip(values, names)]), names, True, i < len(layers) - 1)
    return idle


@dataclass(frozen=True)
class TypedWeights:
    """Weights of one typed layer: a matrix per node type, an embedding per edge type,
    the attribute embedding, the score vector over (target, source, type, attributes),
    and the output map over (source, attributes).
    """

    node: list[Matrix]
    node_bias: list[list[float]]
    edge_type: list[list[float]]
    attr: Matrix
    score: list[float]
    out: Matrix
    out_bias: list[float]


def typed_layer(
    nodes: DataFrame, edges: DataFrame, keys: list[str], width: int, attrs: list[str], w: TypedWeights,
    normalise: bool = True, activate: bool = False, slope: float = 0.2,
) -> DataFrame:
    """Attention where node type and edge type enter the message.

    Everything that depends on one node or one edge type is computed there: an edge adds
    two node scalars, one number per edge type and its attribute part. The output map is
    linear, so it is applied once per node after the weighted sum.
    """
    hidden = len(w.node[0])
    nodes = stage(nodes, "typed-nodes")
    x = [F.col(c) for c in vector_names("x", width)]
    per_type = [project(x, m, b) for m, b in zip(w.node, w.node_bias)]
    own = []
    for i in range(hidden):
        value = per_type[-1][i]
        for t in range(len(per_type) - 2, -1, -1):
            value = F.when(F.col("node_type") == t, per_type[t][i]).otherwise(value)
        own.append(value.alias(f"_h{i}"))
    h = vector_names("_h", hidden)
    type_size, attr_size = len(w.edge_type[0]), len(w.attr)
    to, frm = w.score[:hidden], w.score[hidden : 2 * hidden]
    by_type, by_attr = w.score[2 * hidden : 2 * hidden + type_size], w.score[2 * hidden + type_size :]
    type_term = [
        sum((v if v >= 0 else slope * v) * s for v, s in zip(embedding, by_type)) for embedding in w.edge_type
    ]
    projected = nodes.select(*keys, "node", *own)
    source = projected.select(*keys, F.col("node").alias("src"), *h, dot([F.col(c) for c in h], frm).alias("_from"))
    target = projected.select(*keys, F.col("node").alias("dst"), dot([F.col(c) for c in h], to).alias("_to"))
    e_names = vector_names("_e", attr_size)
    embedded = [leaky_relu(v, slope).alias(n) for v, n in zip(project([F.col(a) for a in attrs], w.attr), e_names)]
    prepared = edges.select(*keys, "src", "dst", "edge_type_code", *embedded)
    type_score = F.element_at(F.lit([float(v) for v in type_term]), F.col("edge_type_code") + 1)
    raw_score = F.col("_to") + F.col("_from") + type_score + dot([F.col(n) for n in e_names], by_attr)
    scored = stage(
        prepared.join(source, [*keys, "src"]).join(target, [*keys, "dst"])
        .select(*keys, "src", "dst", leaky_relu(raw_score, slope).alias("_s"), *h, *e_names),
        "typed-scores",
    )
    sums = softmax_sums(scored, keys, "_s", [*h, *e_names])
    mapped = project([F.col(n) for n in [*h, *e_names]], w.out, w.out_bias)
    out = len(w.out)
    received = sums.select(*keys, "node", *[v.alias(f"_o{i}") for i, v in enumerate(mapped)])
    # nodes nothing points at receive no message and no bias
    full = nodes.select(*keys, "node", "node_type").join(received, [*keys, "node"], "left")
    final = [F.coalesce(F.col(f"_o{i}"), F.lit(0.0)) for i in range(out)]
    base = full.select(*keys, "node", "node_type", *[v.alias(f"x{i}") for i, v in enumerate(final)])
    return _finish(base, vector_names("x", out), normalise, activate)


def typed_propagate(
    nodes: DataFrame, edges: DataFrame, keys: list[str], width: int, attrs: list[str], layers: list[TypedWeights], slope: float = 0.2
) -> DataFrame:
    """Typed attention rounds, each with layer norm, with ReLU between them and none after the last.

    ``nodes`` lists every node that has an edge, with its ``node_type``, which stays.
    """
    for i, w in enumerate(layers):
        nodes = typed_layer(nodes, edges, keys, width, attrs, w, activate=i < len(layers) - 1, slope=slope)
        width = len(w.out)
    return nodes


def typed_idle(idle: DataFrame, width: int, layers: list[TypedWeights]) -> DataFrame:
    """Typed rounds of nodes without edges, one row per node, valid in every graph that they are silent in.

    No self loops here: nothing arrives, neither message nor bias, so every round leaves zeros, which the layer norm keeps.
    """
    if not layers:
        return idle.select("node", *vector_names("x", width))
    return idle.select("node", *[F.lit(0.0).alias(n) for n in vector_names("x", len(layers[-1].out))])


@dataclass(frozen=True)
class RecurrentLayer:
    """Input and hidden weights of one recurrent layer, gates stacked row-wise.

    Gate order is (reset, update, new) for "gru" and (input, forget, cell, output) for "lstm".
    """

    w_in: np.ndarray
    w_hidden: np.ndarray
    b_in: np.ndarray
    b_hidden: np.ndarray


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-v))


def run_layer(seq: np.ndarray, layer: RecurrentLayer, kind: str) -> np.ndarray:
    """All hidden states [rows, steps, hidden] of one layer over [rows, steps, features]."""
    rows, steps, _ = seq.shape
    size = layer.w_hidden.shape[1]
    h = np.zeros((rows, size))
    c = np.zeros((rows, size))
    states = np.empty((rows, steps, size))
    for t in range(steps):
        a = seq[:, t, :] @ layer.w_in.T + layer.b_in
        b = h @ layer.w_hidden.T + layer.b_hidden
        if kind == "gru":
            reset = _sigmoid(a[:, :size] + b[:, :size])
            update = _sigmoid(a[:, size : 2 * size] + b[:, size : 2 * size])
            new = np.tanh(a[:, 2 * size :] + reset * b[:, 2 * size :])
            h = (1 - update) * new + update * h
        else:
            gates = a + b
            keep = _sigmoid(gates[:, size : 2 * size])
            write = _sigmoid(gates[:, :size]) * np.tanh(gates[:, 2 * size : 3 * size])
            c = keep * c + write
            h = _sigmoid(gates[:, 3 * size :]) * np.tanh(c)
        states[:, t, :] = h
    return states


def _check_kind(kind: str) -> None:
    if kind not in ("gru", "lstm"):
        raise ValueError(f"unknown recurrence {kind!r}")


def _last_state(block: np.ndarray, layers: list[RecurrentLayer], kind: str) -> np.ndarray:
    for layer in layers:
        block = run_layer(block, layer, kind)
    return block[:, -1, :]


def recurrent_encode(sequences: DataFrame, seq: str, steps: int, features: int, layers: list[RecurrentLayer], kind: str = "gru") -> DataFrame:
    """Add ``state``, the last hidden state of each sequence.

    Every row is one bounded sequence, so rows go to Python in Arrow batches wherever they
    are: no shuffle, no grouping.
    """
    _check_kind(kind)

    @F.pandas_udf("array<double>")
    def encode(flat: pd.Series) -> pd.Series:
        if len(flat) == 0:
            return pd.Series([], dtype=object)
        rows = flat.to_numpy()
        blocks = (np.stack(rows[lo:lo + BLOCK_ROWS]) for lo in range(0, len(rows), BLOCK_ROWS))
        return pd.Series([state for block in blocks for state in _last_state(block.reshape(len(block), steps, features), layers, kind)])

    return sequences.withColumn("state", encode(F.flatten(F.col(seq))))


def recurrent_states(
    timelines: DataFrame, batch_size: int, size: int, features: int, layers: list[RecurrentLayer], kind: str = "gru", drop_last: int = 0
) -> DataFrame:
    """(keys, target, state): the last hidden state over the ``size`` bins before every target.

    Each timeline goes to Python once and comes back as one state per target; the windows are
    views of it, so no bin is copied on the way. A worker holds ``BLOCK_ROWS`` timelines' states at a time.
    """
    _check_kind(kind)
    targets = list(range(size, batch_size - drop_last))
    keys = [c for c in timelines.columns if c != "timeline"]
    at = timelines.columns.index("timeline")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in timelines.schema.fields if f.name != "timeline")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if targets else 0, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                block = part.column(at).flatten().flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, batch_size, features)
                # row by row, and within a row target by target
                states = np.stack([_last_state(block[:, t - size:t, :], layers, kind) for t in targets], axis=1)
                width = states.shape[2]
                ends = np.arange(0, states.size + 1, width, dtype=np.int32)
                row = pa.array(np.repeat(np.arange(part.num_rows), len(targets)))
                yield pa.RecordBatch.from_arrays([
                    *[part.column(i).take(row) for i in range(part.num_columns) if i != at],
                    pa.array(np.tile(np.array(targets, np.int32), part.num_rows)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(states.ravel())),
                ], [*keys, "target", "state"])

    return timelines.mapInArrow(run, f"{kinds}, target int, state array<double>")


def end_states(
    active: DataFrame, idle: DataFrame, pairs: DataFrame, batch_keys: list[str], batch_size: int, size: int, width: int,
    layers: list[RecurrentLayer], kind: str = "gru",
) -> tuple[DataFrame, DataFrame]:
    """States of the nodes that ``pairs`` name, for ``score.with_pair_vectors``: (keys, bin, node, state) and (node, state).

    ``active`` has the vectors of nodes with edges, graph by graph, ``idle`` those of a node without, one row per node. Only
    timelines of named nodes go to Python; a node silent in the whole batch has the second table's state in every bin.
    """
    names = vector_names("x", width)
    ends = pairs.select(*batch_keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    named = active.join(ends, [*batch_keys, "node"], "left_semi")
    lines = sequence.batch_timelines(named, batch_keys, batch_size, names, idle)
    states = recurrent_states(lines, batch_size, size, width, layers, kind).withColumnRenamed("target", "bin")
    still = idle.select("node", F.array_repeat(F.array(*names), size).alias("seq"))
    return states, recurrent_encode(still, "seq", size, width, layers, kind).drop("seq")
