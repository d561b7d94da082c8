import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.functions.linear import weight_matrix, weight_vector
from chronomesh.operators import dims, graph, label, propagate, score, sequence
from chronomesh.operators.stats import first_seen, novelty

KEYS = ["batch", "bin"]


def edge_table(spark, data):
    return spark.createDataFrame([(0, b, s, d, float(v), i) for i, (b, s, d, v) in enumerate(data)], "batch int, bin int, src long, dst long, v double, id int")


@pytest.mark.parametrize("mode,value", [("add", 4.0), ("mean", 2.0), ("min", 1.0), ("max", 3.0), ("mul", 3.0), ("first", 1.0)])
def test_dedup(spark, mode, value):
    edges = edge_table(spark, [(0, 1, 2, 1), (0, 1, 2, 3), (0, 1, 1, 2), (0, 2, 1, 5)])
    out = {(r["src"], r["dst"]): r["v"] for r in graph.dedup_edges(edges, KEYS, ["v"], mode, ["id"]).collect()}
    assert out == {(1, 2): value, (1, 1): 2.0, (2, 1): 5.0}


def test_self_loops_and_degrees(spark):
    edges = edge_table(spark, [(0, 1, 2, 1), (0, 1, 2, 3), (0, 1, 1, 2)])
    assert graph.remove_self_loops(edges).count() == 2
    assert graph.remove_self_loops(edges, bipartite=True).count() == 3
    got = {r["node"]: (r["in_degree"], r["out_degree"]) for r in graph.node_degrees(edges, KEYS).collect()}
    assert got == {1: (1, 3), 2: (2, 0)}
    swapped = {r["node"]: (r["in_degree"], r["out_degree"]) for r in graph.node_degrees(edges, KEYS, swapped=True).collect()}
    assert swapped == {1: (3, 1), 2: (0, 2)}


def test_redteam_repeats_do_not_multiply(spark):
    auth = spark.createDataFrame(
        [(1, 10, "a", "b", "X", "Y"), (2, 10, "c", "a", "X", "Y"), (3, 11, "a", "b", "X", "Y"), (4, 10, "a", "b", "X", "Z")],
        "auth_id int, time long, src_user string, dst_user string, src_computer string, dst_computer string",
    )
    listed = spark.createDataFrame([(10, "a", "X", "Y")] * 3, "time long, user_name string, src_computer string, dst_computer string")
    got = {r["auth_id"]: r["malicious"] for r in label.label_redteam(auth, listed).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False}


def test_malicious_flag_on_null(spark):
    df = spark.createDataFrame([("none",), ("Discovery",), (None,)], "label_tactic string")
    assert [r["mal"] for r in label.malicious_flag(df).collect()] == [False, True, True]


def test_unique_key_check(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "host string, port int")
    assert dims.require_unique(df, ["host", "port"]) is df
    with pytest.raises(ValueError, match="not unique"):
        dims.require_unique(df, ["host"])


@pytest.mark.parametrize("block", [3, 50, 65536])
def test_negative_edges_are_whole(spark, block):
    """A hot graph holds most edges; a nearly complete graph has few non-edges left."""
    n = 12
    full = [(1, s, d, 0) for s in range(n) for d in range(n) if s != d and (s, d) not in ((3, 4), (5, 0))]
    hot = [(0, i % n, (i * 5 + 1) % n, 0) for i in range(90)]
    edges = edge_table(spark, hot + full + [(2, 1, 1, 0)])
    out = graph.negative_edges(edges, n, KEYS, block=block).collect()
    by_bin = {}
    for r in out:
        by_bin.setdefault(r["bin"], []).append((r["src"], r["dst"]))
    real = {b: {(s, d) for x, s, d, _ in hot + full if x == b} for b in (0, 1)}
    assert set(by_bin[1]) == {(3, 4), (5, 0)}
    loop_free = {(s, d) for s, d in real[0] if s != d}
    assert len(by_bin[0]) == min(90, n * (n - 1) - len(loop_free))
    assert len(by_bin[2]) == 1
    for b, pairs in by_bin.items():
        assert len(set(pairs)) == len(pairs)
        assert not set(pairs) & real.get(b, set())
        assert all(s != d and 0 <= s < n and 0 <= d < n for s, d in pairs)


def test_negative_edges_do_not_depend_on_the_block(spark):
    edges = edge_table(spark, [(0, i % 40, (i * 7 + 3) % 40, 0) for i in range(200)])
    one, two = (sorted(map(tuple, graph.negative_edges(edges, 40, KEYS, block=b).collect())) for b in (7, 65536))
    assert one == two and len(one) == 200


def test_large_populations_use_wide_arithmetic(spark):
    edges = edge_table(spark, [(0, 1, 2, 0), (0, 3, 4, 0)])
    out = graph.negative_edges(edges, 3_000_000, KEYS).collect()
    step, population = graph.stride(3_000_000 * 2_999_999), 3_000_000 * 2_999_999
    import hashlib

    start = int(hashlib.md5(b"42:0:0").hexdigest()[:15], 16) % population
    codes = [(start + i * step) % population for i in range(2)]
    want = [(c // 2_999_999, c % 2_999_999 + (c % 2_999_999 >= c // 2_999_999)) for c in codes]
    assert sorted((r["src"], r["dst"]) for r in out) == sorted(want)


def test_sequences(spark):
    nodes = spark.createDataFrame([(0, 1, 7, 5.0), (0, 3, 7, 6.0)], "batch int, bin int, node long, f double")
    lines = sequence.batch_timelines(nodes, ["batch"], 5, ["f"])
    out = {r["target"]: [x[0] for x in r["seq"]] for r in sequence.sliding_sequences(lines, 5, 2).collect()}
    assert out == {2: [0.0, 5.0], 3: [5.0, 0.0], 4: [0.0, 6.0]}
    assert sequence.sliding_sequences(lines, 5, 2, drop_last=1).count() == 2
    assert sequence.sliding_sequences(lines, 5, 5).count() == 0
    last = {r["target"]: r["x"] for r in sequence.last_values(lines, 5, 2).collect()}
    assert last == {2: [5.0], 3: [0.0], 4: [6.0]}


def test_novelty_sums_to_distinct(spark):
    df = spark.createDataFrame(
        [(0, 0, 0, "a", "b"), (0, 0, 2, "b", "c"), (1, 0, 0, "a", "d"), (0, 1, 1, None, "e")], "file_id int, batch long, bin int, src_ip string, dest_ip string"
    )
    out = novelty(df, ["file_id", "batch"], 3, ["src_ip"], {"hosts": [["src_ip"], ["dest_ip"]]})
    got = {(r["file_id"], r["batch"], r["bin"]): (r["new_src_ip"], r["new_hosts"]) for r in out.collect()}
    assert got == {
        (0, 0, 0): (1, 2), (0, 0, 1): (0, 0), (0, 0, 2): (1, 1), (0, 1, 0): (0, 0), (0, 1, 1): (0, 1), (0, 1, 2): (0, 0),
        (1, 0, 0): (0, 1), (1, 0, 1): (0, 0), (1, 0, 2): (0, 0),
    }
    plan = first_seen(df, F.col("bin").cast("bigint"), ["src_ip"], {})._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def brute_gcn(x, edges, layers):
    n = len(x)
    a = np.zeros((n, n))
    for s, d in edges:
        if s != d:
            a[d, s] += 1
    a += np.eye(n)
    deg = a.sum(axis=1)
    norm = a / np.sqrt(np.outer(deg, deg))
    for i, (w, b) in enumerate(layers):
        x = norm @ (x @ np.array(w).T) + np.array(b)
        if i < len(layers) - 1:
            x = np.maximum(x, 0)
    return x


EDGES = [(0, 1), (0, 1), (1, 2), (2, 2), (2, 0), (3, 1), (0, 3), (3, 3), (3, 3)]


def node_table(spark, x):
    names = ", ".join(f"x{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame([(0, 0, i, *map(float, row)) for i, row in enumerate(x)], f"batch int, bin int, node long, {names}")


def test_gcn_against_matrices(spark):
    x = np.random.default_rng(1).normal(size=(4, 3))
    layers = [(weight_matrix(2, 3, 1), weight_vector(2, 2)), (weight_matrix(2, 2, 3), weight_vector(2, 4))]
    edges = edge_table(spark, [(0, s, d, 1) for s, d in EDGES])
    out = propagate.gcn_propagate(node_table(spark, x), edges, KEYS, 3, layers).orderBy("node").collect()
    assert np.allclose([[r["x0"], r["x1"]] for r in out], brute_gcn(x, EDGES, layers))


def test_attention_against_loops(spark):
    rng = np.random.default_rng(2)
    x, attr = rng.normal(size=(4, 3)), rng.normal(size=len(EDGES))
    w = propagate.AttentionWeights(
        rng.normal(size=(2, 3)).tolist(), [0.1, -0.2], rng.normal(size=(2, 3)).tolist(), [0.3, 0.1], rng.normal(size=(2, 1)).tolist(), [0.7, -0.4], [0.05, 0.02]
    )
    edges = edge_table(spark, [(0, s, d, a) for (s, d), a in zip(EDGES, attr)])
    out = propagate.attention_layer(node_table(spark, x), edges, KEYS, 3, ["v"], w, normalise=False).orderBy("node").collect()
    left, right = x @ np.array(w.source).T + w.source_bias, x @ np.array(w.target).T + w.target_bias
    want = np.zeros((4, 2))
    for v in range(4):
        incoming = [(s, a) for (s, d), a in zip(EDGES, attr) if d == v and s != v]
        incoming.append((v, np.mean([a for _, a in incoming]) if incoming else 0.0))
        mixed = np.array([left[s] + right[v] + np.array(w.edge)[:, 0] * a for s, a in incoming])
        scores = np.where(mixed >= 0, mixed, 0.2 * mixed) @ np.array(w.score)
        alpha = np.exp(scores - scores.max())
        want[v] = (alpha / alpha.sum()) @ left[[s for s, _ in incoming]] + w.bias
    assert np.allclose([[r["x0"], r["x1"]] for r in out], want)


def test_layer_norm_of_a_wide_vector(spark):
    x = np.random.default_rng(4).normal(size=(3, 96))
    from chronomesh.functions.linear import layer_norm

    names = [f"x{i}" for i in range(96)]
    out = np.array([[r[n] for n in names] for r in layer_norm(node_table(spark, x), names).orderBy("node").collect()])
    assert np.allclose(out, (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5))


@pytest.mark.parametrize("kind,gates", [("gru", 3), ("lstm", 4)])
def test_recurrence_against_one_row_at_a_time(spark, kind, gates):
    rng = np.random.default_rng(3)
    hidden, feats, steps = 2, 3, 5
    layers = [
        propagate.RecurrentLayer(rng.normal(size=(gates * hidden, w)), rng.normal(size=(gates * hidden, hidden)), rng.normal(size=gates * hidden), rng.normal(size=gates * hidden))
        for w in (feats, hidden)
    ]
    data = rng.normal(size=(4, steps, feats))
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(data)], "i int, seq array<array<double>>")
    out = {r["i"]: r["state"] for r in propagate.recurrent_encode(df, "seq", steps, feats, layers, kind).collect()}

    def sig(v):
        return 1 / (1 + np.exp(-v))

    for i, seq in enumerate(data):
        for layer in layers:
            h, c, states = np.zeros(hidden), np.zeros(hidden), []
            for x in seq:
                a, b = layer.w_in @ x + layer.b_in, layer.w_hidden @ h + layer.b_hidden
                if kind == "gru":
                    r, z = sig(a[:2] + b[:2]), sig(a[2:4] + b[2:4])
                    h = (1 - z) * np.tanh(a[4:] + r * b[4:]) + z * h
                else:
                    g = a + b
                    c = sig(g[2:4]) * c + sig(g[:2]) * np.tanh(g[4:6])
                    h = sig(g[6:]) * np.tanh(c)
                states.append(h)
            seq = np.array(states)
        assert np.allclose(out[i], seq[-1])


def test_pair_scores_against_matrices(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(5, 3))
    nodes = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "node long, embedding array<double>")
    pairs = spark.createDataFrame([(0, 1), (4, 4), (2, 3)], "src long, dst long")
    w = rng.normal(size=(3, 3))
    got = {(r["src"], r["dst"]): r["link_logit"] for r in score.bilinear_link_score(pairs, nodes, w.tolist(), 0.5).collect()}
    assert all(np.isclose(v, z[s] @ w @ z[d] + 0.5) for (s, d), v in got.items()) and len(got) == 3
    first, b1, second, b2 = rng.normal(size=(4, 6)), rng.normal(size=4), rng.normal(size=4), 0.25
    scored = score.mlp_link_score(pairs, nodes, 3, first.tolist(), b1.tolist(), second.tolist(), b2)
    hidden = lambda s, d, m, b: np.maximum(m @ np.concatenate([z[s], z[d]]) + b, 0)
    for r in scored.collect():
        assert np.isclose(r["link_logit"], hidden(r["src"], r["dst"], first, b1) @ second + b2)
    cf, cs, cb = rng.normal(size=(4, 7)), rng.normal(size=(2, 4)), rng.normal(size=2)
    for r in score.link_class_score(scored, nodes, 3, cf.tolist(), b1.tolist(), cs.tolist(), cb.tolist()).collect():
        p = 1 / (1 + np.exp(-r["link_logit"]))
        h = np.maximum(cf @ np.concatenate([z[r["src"]], z[r["dst"]], [p]]) + b1, 0)
        assert np.allclose(r["class_logits"], cs @ h + cb)


def test_ids_of_known_values_stay(spark):
    frame = lambda rows: spark.createDataFrame(rows, "src_ip string, dest_ip string")
    ends, first = [["src_ip"], ["dest_ip"]], dims.host_map(frame([("b", "d"), ("d", None)]))
    second = dims.extend_map(first, frame([("a", "d"), ("e", "b"), ("a", "c")]), ends, ["host"], "host_id")
    assert {r.host: r.host_id for r in second.collect()} == {"b": 0, "d": 1, "a": 2, "c": 3, "e": 4}
    assert dims.new_entries(second, frame([("a", "e")]), ends, ["host"], "host_id").count() == 0
    nothing = dims.host_map(frame([(None, None)]))
    assert [r.host_id for r in dims.extend_map(nothing, frame([("x", "y")]), ends, ["host"], "host_id").orderBy("host").collect()] == [0, 1]


def test_a_worker_encodes_few_timelines_at_a_time(spark):
    limit = 512

    class Few(np.ndarray):
        """A bias that refuses to be added to more rows at once."""

        def __array_ufunc__(self, ufunc, method, *inputs, **kwargs):
            inputs = [np.asarray(x) for x in inputs]
            assert all(len(x) <= limit for x in inputs if x.ndim > 1)
            return getattr(ufunc, method)(*inputs, **kwargs)

    rng = np.random.default_rng(6)
    matrices = [rng.normal(size=s) for s in ((9, 2), (9, 3), 9, 9)]
    plain = propagate.RecurrentLayer(*matrices)
    layer = propagate.RecurrentLayer(matrices[0], matrices[1], matrices[2].view(Few), matrices[3])
    lines = rng.normal(size=(1300, 5, 2))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(lines)], "node long, timeline array<array<double>>").coalesce(1)
    got = {(r.node, r.target): r.state for r in propagate.recurrent_states(frame, 5, 3, 2, [layer]).collect()}
    assert len(got) == 2600
    for target in (3, 4):
        want = propagate.run_layer(lines[:, target - 3:target], plain, "gru")[:, -1]
        assert np.allclose([got[i, target] for i in range(1300)], want)
    rows = frame.selectExpr("node", "slice(timeline, 1, 3) AS seq")
    states = {r.node: r.state for r in propagate.recurrent_encode(rows, "seq", 3, 2, [layer]).collect()}
    assert np.allclose([states[i] for i in range(1300)], propagate.run_layer(lines[:, :3], plain, "gru")[:, -1])
    assert propagate.recurrent_states(frame, 5, 5, 2, [layer]).count() == 0


def test_pair_scores_run_no_function_per_element(spark, capsys):
    rng = np.random.default_rng(8)
    z, shape = rng.normal(size=(7, 4)), [(5, 4), 5, 5, (5, 5), 5, (3, 5), 3]
    first, b1, second, cf, cb1, cs, cb2 = (rng.normal(size=s) for s in shape)
    pairs = spark.createDataFrame([(i, r[:2].tolist(), r[2:].tolist()) for i, r in enumerate(z)], "i int, zs array<double>, zd array<double>")
    listed = lambda *arrays: [a.tolist() for a in arrays]
    scored = score.pair_scores(pairs, 2, *listed(first, b1, second), 0.25, *listed(cf, cb1, cs, cb2))
    for r in scored.collect():
        link = np.maximum(first @ z[r.i] + b1, 0) @ second + 0.25
        inner = np.maximum(cf @ np.append(z[r.i], 1 / (1 + np.exp(-link))) + cb1, 0)
        assert np.isclose(r.link_logit, link) and np.allclose(r.class_logits, cs @ inner + cb2)
    w, bf = rng.normal(size=(2, 2)), rng.normal(size=(5, 4))
    bilinear = score.pair_bilinear_scores(pairs, w.tolist(), 0.5, *listed(bf, cb1, cs, cb2))
    for r in bilinear.collect():
        assert np.isclose(r.link_logit, z[r.i, :2] @ w @ z[r.i, 2:] + 0.5)
        assert np.allclose(r.class_logits, cs @ np.maximum(bf @ z[r.i] + cb1, 0) + cb2)
    for frame in (scored, bilinear):
        capsys.readouterr()
        frame.explain()
        assert "lambdafunction" not in capsys.readouterr().out
        assert frame.columns == ["i", "zs", "zd", "link_logit", "class_logits"]


def test_convolution_joins_anew_only_pairs_of_senders_that_receive(spark, monkeypatch):
    """Hosts 0 to 4 only send; 5 and 6 receive, and only 5 -> 6 has a sender whose state depends on others."""
    staged = {}
    write = propagate.stage
    monkeypatch.setattr(propagate, "stage", lambda df, tag: staged.setdefault(tag, []).append(write(df, tag)) or staged[tag][-1])
    rows = [(0, 5), (1, 5), (2, 5), (2, 5), (3, 6), (4, 4), (5, 6)]
    edges = spark.createDataFrame([(0, s, d) for s, d in rows], "bin int, src long, dst long")
    draw = np.random.default_rng(9)
    x = draw.standard_normal((7, 3))
    nodes = spark.createDataFrame([(0, i, *map(float, v), f"n{i}") for i, v in enumerate(x)], "bin int, node long, x0 double, x1 double, x2 double, name string")
    layers = [(draw.standard_normal((2, 3)).tolist(), [0.1, -0.2]), (draw.standard_normal((2, 2)).tolist(), [0.3, 0.1])]
    got = {r.node: r for r in propagate.gcn_states(nodes, edges, ["bin"], 3, layers, ["name"]).collect()}
    adjacency = {(r.src, r.dst) for r in staged["gcn-adjacency"][0].collect()}
    assert adjacency == {(5, 6), (5, 5), (6, 6)}
    weights = np.eye(7)
    for s, d in rows:
        weights[d, s] += s != d
    degree = weights.sum(axis=1)
    norm = weights / np.sqrt(np.outer(degree, degree))
    for i, (w, b) in enumerate(layers):
        x = norm @ x @ np.array(w).T + b
        x = np.maximum(x, 0) if i == 0 else x
    assert sorted(got) == list(range(7))
    for i in range(7):
        assert [got[i].x0, got[i].x1] == pytest.approx(x[i].tolist()) and got[i].d == degree[i] and got[i].name == f"n{i}"
