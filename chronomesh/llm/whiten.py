"""Embedding whitening: the leading components of the covariance, each scaled to variance 1.

A vector's entries c become whole numbers x = floor(1024 c) + 100000. All vectors are the fit list: n of them, with
sums S per dimension. A first pass sums x exactly; a second one sums the products of centred entries, one matrix a task,
combined by entry. The covariance is as large as the dimensions, not the table, and goes to the driver, where
``eigen`` finds its leading vectors (Householder, Sturm bisection, inverse iteration). A third pass projects every vector on
the components, which travel with the tasks; two sums over its result give the error of the identity.

Defined results: vectors that are null, empty, or hold null or non-finite entries or some beyond ``LARGEST`` are
dropped, and so are those of another length than most have (of several such lengths, the longest counts); repeated
ids and rows are kept; a null id passes; components whose variance is no more than ``NOTHING`` of the largest are left
out, so equal vectors, one vector or an empty table give no rows; ``deviation`` is null where it exceeds a long. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.llm import eigen
from chronomesh.llm.store import staged

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Larger entries would not have exact x as doubles.
LARGEST = float(1 << 42)
#: Share of the largest variance that counts as none.
NOTHING = 1e-10
LONG = 1 << 63


def _usable(vec: Column) -> Column:
    return F.forall(vec, lambda c: c.isNotNull() & (c >= -LARGEST) & (c <= LARGEST)) & (F.size(vec) > 0)


def integers(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, x) of the vectors of every length in a list column without nulls."""
    length = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(length):
        at = np.flatnonzero(length == size)
        part = column if len(at) == len(column) else column.take(pa.array(at))
        c = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        yield at, np.floor(SCALE * c).astype(np.int64) + SHIFT


def exact(x: np.ndarray, most: int) -> np.ndarray:
    """``x`` in a type in which values up to ``most`` are exact."""
    return x if most < LONG else x.astype(object)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in integers(batch.column(0)):
            n, size = x.shape
            column = exact(x, n * int(np.abs(x).max())).sum(axis=0).astype(object)
            total = held.setdefault(size, [0, np.zeros(size, object)])
            total[0] += n
            total[1] += column
    for size, (n, total) in held.items():
        yield pa.RecordBatch.from_arrays([
            pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([n] * size, pa.int64()),
            pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0)),
        ], ["size", "i", "n", "s"])


@dataclass(frozen=True)
class Whitening:
    """S = n * whole + rest, per dimension; ``components`` are unit rows, ``values`` their variances."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.whole)

    def near(self, x: np.ndarray) -> np.ndarray:
        """x less the whole part of its mean, exact."""
        return x - self.whole

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.near(x) - self.rest / max(self.n, 1)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S) ** 2, exact."""
        y, n = self.near(x), self.n
        most = int(np.abs(y).max(initial=0))
        square = exact(y, most * most * self.size)
        square = (square * square).sum(axis=1)
        cross = exact(y, most * n * self.size) @ (self.rest if most * n * self.size < LONG else self.rest.astype(object))
        ends = sum(int(r) ** 2 for r in self.rest)
        found = [n * n * int(a) - 2 * n * int(b) + ends for a, b in zip(square, cross)]
        return pa.array([d if d < LONG else None for d in found], pa.int64())


def _covariance(rows: DataFrame, model: Whitening) -> np.ndarray:
    """The covariance of the fit list, from one sum of centred products a task."""
    size = model.size

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((size, size)), False
        for batch in batches:
            for _, x in integers(batch.column(0)):
                y = model.centred(x)
                total += y.T @ y
                any_ = True
        if any_:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    sums = rows.select("vec").mapInArrow(products, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    i, j, v = (sums[c].to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v / model.n
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors ``vec`` of ``rows``, as ``vectors`` gives them; ``n`` is 0 where there are none."""
    found = rows.select("vec").mapInArrow(_sums, "size int, i int, n long, s decimal(38,0)")
    sums = found.groupBy("size", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # dimensions, not vectors
    n, size = max(((r["n"], r["size"]) for r in sums), default=(0, 0))
    total = [int(r["s"]) for r in sorted((r for r in sums if r["size"] == size), key=lambda r: r["i"])]
    whole, rest = np.array([s // n for s in total], np.int64), np.array([s % n for s in total], np.int64)
    start = Whitening(n, whole, rest, np.zeros(0), np.zeros((0, size)), 0.0)
    if not n:
        return start
    cov = _covariance(rows.filter(F.size("vec") == size), start)
    values, vectors = eigen.leading(cov, components)
    real = values > NOTHING * max(values[0], 0.0)
    return Whitening(n, whole, rest, values[real], vectors[real], float(np.trace(cov)))


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that can be used."""
    return table.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec")).filter(F.col("vec").isNotNull() & _usable(F.col("vec")))


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, w): the whitened coordinates of every vector of the model's length."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    onto = model.components.T / np.sqrt(model.values)  # bounded by the dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column(1)):
                w = model.centred(x) @ onto
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(at)), model.deviation(x),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel())),
                ], ["vec_id", "deviation", "w"])

    return rows.filter(F.size("vec") == model.size).mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity."""
    w = [F.get("w", F.lit(i)) for i in range(k)]
    mean = projected.agg(*[F.avg(c) for c in w]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = projected.agg(*[F.avg((w[i] - mean[i]) * (w[j] - mean[j])) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(cov, pairs))


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every vector and component."""
    rows = vectors(table, id_col, vec_col)
    model = fit(rows, components)
    k = len(model.values)
    if not k:
        return rows.limit(0).select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")])
    done = staged(project(rows, model), "whitened")
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(identity_error(done, k))).alias("identity_error"))
