import math

import numpy as np
import pytest

from chronomesh.llm import eigen, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, w int, __id int, component string"


def frame(spark, vectors, parts=4):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2, "x") for i, v in vectors]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def brute(vectors, k=8):
    """Everything anew with whole numbers and numpy's own solver."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors]
    n, total = len(x), [sum(col) for col in zip(*x)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(row, total)] for row in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    return n, deviation, centred @ vecs / np.sqrt(values), values / np.trace(centred.T @ centred / n)


def check(spark, df, vectors):
    n, deviation, whitened, explained = brute(vectors)
    rows = whiten.whiten(df).toPandas()
    k = whitened.shape[1]
    assert len(rows) == len(vectors) * k and set(rows.n) == {n} and rows.identity_error.nunique() == 1
    assert rows.identity_error.iloc[0] < 1e-8
    place = {i: at for at, (i, _) in enumerate(vectors)}
    for c in range(k):
        got = rows[rows.component == c + 1].sort_values("vec_id")
        at = [place[i] for i in got.vec_id]
        assert got.deviation.tolist() == [deviation[i] for i in at]
        assert np.allclose(got.explained, explained[c], rtol=1e-9)
        want = whitened[at, c]
        sign = np.sign(want @ got.whitened.to_numpy())
        assert np.allclose(got.whitened, sign * want, atol=1e-6)


def test_brute_force_over_the_given_table(spark, tiny):
    df = spark.read.parquet(f"{tiny}/embeddings.parquet")
    check(spark, df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_hot_vector_and_repeated_rows(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, draw.standard_normal(12) * 2.0 ** -np.arange(12)) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(200)]
    check(spark, frame(spark, vectors, 7), vectors)


def test_dropped_rows(spark):
    draw = np.random.default_rng(4)
    good = [(i, draw.standard_normal(9)) for i in range(60)]
    bad = [(100, None), (101, [float("nan")] * 9), (102, [None] * 9), (103, [1.0] * 8), (104, []), (105, [float("inf")] + [0.0] * 8),
           (106, [1e30] + [0.0] * 8)]
    check(spark, frame(spark, good + bad), good)


def test_nothing_to_whiten(spark):
    for vectors in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.5, 0.5]) for i in range(9)], [(1, None)]):
        got = whiten.whiten(frame(spark, vectors))
        assert got.collect() == [] and dict(got.dtypes)["deviation"] == "bigint"


def test_fewer_components_than_asked_for(spark):
    draw = np.random.default_rng(5)
    flat = draw.integers(-9, 9, (50, 2)) @ draw.integers(-3, 3, (2, 6))
    rows = whiten.whiten(frame(spark, list(enumerate(flat.astype(float))))).toPandas()
    assert rows.component.max() == 2 and rows.identity_error.max() < 1e-8 and len(rows) == 100


def test_null_ids_and_a_deviation_beyond_a_long(spark):
    rows = whiten.whiten(frame(spark, [(None, [2.0 ** 40, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0])])).toPandas()
    assert len(rows) == 3 and rows.deviation.isna().all()


@pytest.mark.parametrize("kind", ["spread", "cluster", "equal", "split", "low rank"])
def test_eigenvectors(kind):
    draw = np.random.default_rng(6)
    n = 40
    q, _ = np.linalg.qr(draw.standard_normal((n, n)))
    values = {
        "spread": np.geomspace(1e6, 1e-3, n), "cluster": 5 + 1e-9 * np.arange(n)[::-1], "equal": np.repeat([7.0, 3.0, 1.0, 0.5], 10),
        "split": np.arange(n, 0, -1.0), "low rank": np.append([4.0, 2.0, 2.0], np.zeros(n - 3)),
    }[kind]
    a = np.diag(values[::-1]) if kind == "split" else q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, vectors = eigen.leading(a, 8)
    assert np.allclose(got, np.sort(values)[::-1][:8], atol=1e-12 * values.max())
    assert np.allclose(vectors @ vectors.T, np.eye(8), atol=1e-10)
    assert np.abs(a @ vectors.T - vectors.T * got).max() < 1e-11 * values.max()


def test_sturm_counts():
    draw = np.random.default_rng(7)
    d, e = draw.standard_normal(20), draw.standard_normal(19)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.linspace(-4, 4, 50)
    assert eigen.below(d, e, shifts).tolist() == [(values < s).sum() for s in shifts]
