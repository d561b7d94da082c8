"""Small dense algebra written as column expressions.

A vector is a list of columns (``x0, x1, ...``) so that sums and products stay inside
whole-stage code generation, or an array column where it must travel as one value.
Matrices are given weights: plain Python lists, a few hundred numbers at most.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[float]]


def weight_matrix(rows: int, cols: int, seed: int) -> Matrix:
    """A fixed, well-spread example matrix for queries and tests."""
    return [[((i * 7 + j * 11 + seed * 5) % 13 - 6) / 11.3 for j in range(cols)] for i in range(rows)]


def weight_vector(size: int, seed: int) -> list[float]:
    return weight_matrix(1, size, seed)[0]


def array_literal(values: list[float]) -> Column:
    """A vector constant as one literal instead of one expression per number."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def matrix_literal(weight: Matrix) -> Column:
    return F.from_json(F.lit(json.dumps([[float(v) for v in row] for row in weight])), "array<array<double>>")


def add(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: list[Column], b: list) -> Column:
    return add([x * (y if isinstance(y, Column) else F.lit(float(y))) for x, y in zip(a, b)])


def project(x: list[Column], weight: Matrix, bias: list[float] | None = None) -> list[Column]:
    """``weight`` times ``x`` (one row of ``weight`` per output)."""
    out = [dot(x, row) for row in weight]
    return out if bias is None else [o + F.lit(float(b)) for o, b in zip(out, bias)]


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * F.lit(slope))


def layer_norm(df: DataFrame, names: list[str], eps: float = 1e-5) -> DataFrame:
    """Normalise the vector held in ``names``. Mean and variance are columns of their own,
    so the expression grows with the width, not with its cube.
    """
    size = F.lit(float(len(names)))
    df = df.withColumn("_mean", add([F.col(n) for n in names]) / size)
    off = [F.col(n) - F.col("_mean") for n in names]
    df = df.withColumn("_scale", F.sqrt(add([d * d for d in off]) / size + F.lit(eps)))
    return df.withColumns({n: d / F.col("_scale") for n, d in zip(names, off)}).drop("_mean", "_scale")


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def array_project(x: Column, weight: Matrix) -> Column:
    return F.transform(matrix_literal(weight), lambda row: array_dot(row, x))
