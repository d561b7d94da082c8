"""Edge scores and edge classes from node embeddings with given weights.

A matrix that meets the source or the target embedding is applied once per node, before
the join; what is left per edge is one dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.functions.linear import Matrix, array_dot, array_literal, array_project, dot, project, relu
from chronomesh.functions.scalar import sigmoid


def _pair(pairs: DataFrame, src_side: DataFrame, dst_side: DataFrame) -> DataFrame:
    return pairs.join(src_side, "src").join(dst_side, "dst")


def bilinear_link_score(pairs: DataFrame, nodes: DataFrame, weight: Matrix, bias: float, node: str = "node", emb: str = "embedding") -> DataFrame:
    """``src . (weight dst) + bias`` per pair."""
    src_side = nodes.select(F.col(node).alias("src"), F.col(emb).alias("_a"))
    dst_side = nodes.select(F.col(node).alias("dst"), array_project(F.col(emb), weight).alias("_b"))
    return _pair(pairs, src_side, dst_side).withColumn(
        "link_logit", array_dot(F.col("_a"), F.col("_b")) + F.lit(float(bias))
    ).drop("_a", "_b")


def _hidden_sides(nodes: DataFrame, first: Matrix, size: int, node: str, emb: str) -> tuple[DataFrame, DataFrame]:
    """First-layer parts of the source and the target embedding."""
    src_part = [row[:size] for row in first]
    dst_part = [row[size : 2 * size] for row in first]
    return (
        nodes.select(F.col(node).alias("src"), array_project(F.col(emb), src_part).alias("_a")),
        nodes.select(F.col(node).alias("dst"), array_project(F.col(emb), dst_part).alias("_b")),
    )


def _relu_sum(*parts):
    total = parts[0]
    for part in parts[1:]:
        total = F.zip_with(total, part, lambda x, y: x + y)
    return F.transform(total, lambda v: F.greatest(v, F.lit(0.0)))


def mlp_link_score(
    pairs: DataFrame, nodes: DataFrame, size: int, first: Matrix, first_bias: list[float],
    second: list[float], second_bias: float, node: str = "node", emb: str = "embedding",
) -> DataFrame:
    """Two-layer score of the concatenated pair."""
    src_side, dst_side = _hidden_sides(nodes, first, size, node, emb)
    hidden = _relu_sum(F.col("_a"), F.col("_b"), array_literal(first_bias))
    return _pair(pairs, src_side, dst_side).withColumn(
        "link_logit", array_dot(hidden, array_literal(second)) + F.lit(float(second_bias))
    ).drop("_a", "_b")


def link_class_score(
    scored: DataFrame, nodes: DataFrame, size: int, first: Matrix, first_bias: list[float],
    second: Matrix, second_bias: list[float], node: str = "node", emb: str = "embedding", logit: str = "link_logit",
) -> DataFrame:
    """Class logits from the pair and the link probability (last column of ``first``).

    With ``first`` of width ``2 * size`` the probability is left out.
    """
    src_side, dst_side = _hidden_sides(nodes, first, size, node, emb)
    parts = [F.col("_a"), F.col("_b"), array_literal(first_bias)]
    if len(first[0]) == 2 * size + 1:
        prob = sigmoid(F.col(logit))
        parts.append(F.transform(array_literal([row[-1] for row in first]), lambda v: v * prob))
    hidden = _relu_sum(*parts)
    logits = F.zip_with(array_project(hidden, second), array_literal(second_bias), lambda x, y: x + y)
    return _pair(scored, src_side, dst_side).withColumn("class_logits", logits).drop("_a", "_b")


def with_pair_vectors(pairs: DataFrame, states: DataFrame, idle: DataFrame, keys: list[str], vector: str = "state") -> DataFrame:
    """Add ``zs`` and ``zd``, the vectors of both ends in the pair's graph.

    ``states`` has (keys, node, vector) of the nodes active in a graph, ``idle`` (node, vector) of every node, which
    holds wherever the other has no row. No pair is lost: each side is a left join on unique keys.
    """
    for side, name in (("src", "zs"), ("dst", "zd")):
        active = states.select(*keys, F.col("node").alias(side), F.col(vector).alias("_active"))
        default = idle.select(F.col("node").alias(side), F.col(vector).alias("_idle"))
        pairs = pairs.join(active, [*keys, side], "left").join(default, side, "left")
        pairs = pairs.withColumn(name, F.coalesce("_active", "_idle")).drop("_active", "_idle")
    return pairs


def _elements(name: str, size: int) -> list[Column]:
    return [F.get(F.col(name), i) for i in range(size)]


def _names(prefix: str, size: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(size)]


def pair_scores(
    pairs: DataFrame, size: int, first: Matrix, first_bias: list[float], second: list[float], second_bias: float,
    class_first: Matrix, class_first_bias: list[float], class_second: Matrix, class_second_bias: list[float],
) -> DataFrame:
    """``link_logit`` and ``class_logits`` of rows that carry the vectors of both ends as ``zs`` and ``zd``."""
    ends = _elements("zs", size) + _elements("zd", size)
    hidden, inner = _names("_h", len(first)), _names("_q", len(class_first))
    # a layer is columns of its own, named and not repeated by the next one
    scored = pairs.withColumns(dict(zip(hidden, map(relu, project(ends, first, first_bias)))))
    scored = scored.withColumn("link_logit", dot([F.col(h) for h in hidden], second) + F.lit(float(second_bias)))
    scored = scored.withColumn("_p", sigmoid(F.col("link_logit")))
    scored = scored.withColumns(dict(zip(inner, map(relu, project([*ends, F.col("_p")], class_first, class_first_bias)))))
    logits = F.array(*project([F.col(q) for q in inner], class_second, class_second_bias))
    return scored.withColumn("class_logits", logits).drop(*hidden, *inner, "_p")


def pair_bilinear_scores(
    pairs: DataFrame, weight: Matrix, bias: float, class_first: Matrix, class_first_bias: list[float],
    class_second: Matrix, class_second_bias: list[float],
) -> DataFrame:
    """``link_logit``, bilinear, and ``class_logits``, two-layer, of rows that carry the vectors of both ends as ``zs`` and ``zd``."""
    zs, zd = _elements("zs", len(weight)), _elements("zd", len(weight[0]))
    turned, inner = _names("_h", len(weight)), _names("_q", len(class_first))
    scored = pairs.withColumns(dict(zip(turned, project(zd, weight))))
    scored = scored.withColumn("link_logit", dot(zs, [F.col(h) for h in turned]) + F.lit(float(bias)))
    scored = scored.withColumns(dict(zip(inner, map(relu, project(zs + zd, class_first, class_first_bias)))))
    logits = F.array(*project([F.col(q) for q in inner], class_second, class_second_bias))
    return scored.withColumn("class_logits", logits).drop(*turned, *inner)


@dataclass(frozen=True)
class EdgeClassifier:
    """A fitted classifier. ``labels`` are those it learned; ``trials`` says how every regularisation went."""

    model: object
    labels: list[int]
    reg: float
    trials: list[dict]

    def transform(self, edges: DataFrame) -> DataFrame:
        """``edges`` with ``prediction``, one of the learned labels."""
        if self.model is None:
            return edges.withColumn("prediction", F.lit(self.labels[0]))
        return self.model.transform(edges).withColumn("prediction", F.element_at(F.lit(self.labels), F.col("prediction").cast("int") + 1))


def _class_weight(label: str, benign_weight: float, other_weight: float):
    return F.when(F.col(label) == 0, F.lit(benign_weight)).otherwise(F.lit(other_weight))


def _gradient_sums(model, classes: int, width: int):
    """Per task one row a feature, the intercept last: weighted sums over its edges (_w, _y, _x), by class and by the model's probabilities."""
    coefficients, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, 4 + 2 * classes))
        for batch in batches:
            w, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x = np.ones((len(w), width))
            x[:, :-1] = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(w), width - 1)
            margin = x[:, :-1] @ coefficients.T + intercepts
            p = np.exp(margin - margin.max(axis=1, keepdims=True))
            p *= (w / p.sum(axis=1))[:, None]
            out[:, 0] += w.sum()
            out[:, 1] += (w * w).sum()
            out[:, 2] += w @ x
            out[:, 3] += w @ (x * x)
            out[:, 4:4 + classes] += x.T @ (w[:, None] * (y[:, None] == np.arange(classes)))
            out[:, 4 + classes:] += x.T @ p
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int32()), *[pa.array(c) for c in out.T]],
            ["feature", "_total", "_w2", "_sum", "_squares", *_names("_o", classes), *_names("_e", classes)])

    return run


def classifier_gradient(
    train: DataFrame, fitted: EdgeClassifier, features: str = "features", label: str = "y", benign_weight: float = 1.0, other_weight: float = 5.0
) -> DataFrame:
    """(label, feature, observed, expected): the weighted means that must agree where the loss is least.

    ``observed`` is the weighted mean of a feature over the edges of a class, ``expected`` the same under the model's
    probabilities plus the regularisation's part, which the solver applies to standardised features; their difference is the
    gradient. The last feature is the intercept. Made from the data by sums, one row a task and feature, whatever the solver did.
    """
    from pyspark.ml.functions import vector_to_array

    rows = train.select(
        _class_weight(label, benign_weight, other_weight).alias("_w"), (F.array_position(F.lit(fitted.labels), F.col(label)) - 1).cast("int").alias("_y"),
        vector_to_array(features).alias("_x"))
    classes, width = len(fitted.labels), fitted.model.numFeatures + 1
    names = ["_total", "_w2", "_sum", "_squares", *_names("_o", classes), *_names("_e", classes)]
    parts = rows.mapInArrow(_gradient_sums(fitted.model, classes, width), "feature int, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])
    sums = sums.withColumns({"_o": F.array(*_names("_o", classes)), "_e": F.array(*_names("_e", classes))})
    coefficients = fitted.model.coefficientMatrix.toArray()
    penalty = F.lit([[*(float(fitted.reg) * row).tolist(), 0.0] for row in coefficients])
    each = F.arrays_zip(F.lit(fitted.labels).alias("label"), F.col("_o"), F.col("_e"), penalty.alias("_b"))
    variance = (F.col("_squares") - F.col("_sum") * F.col("_sum") / F.col("_total")) / (F.col("_total") - F.col("_w2") / F.col("_total"))
    return sums.select("feature", "_total", variance.alias("_var"), F.inline(each)).select(
        "label", "feature", (F.col("_o") / F.col("_total")).alias("observed"),
        (F.col("_e") / F.col("_total") + F.element_at("_b", F.col("feature") + 1) * F.col("_var")).alias("expected"))


def fit_edge_classifier(
    train: DataFrame, validation: DataFrame, features: str = "features", label: str = "y",
    benign_weight: float = 1.0, other_weight: float = 5.0, reg_params: tuple[float, ...] = (0.01, 0.1), max_iter: int = 1000, tol: float = 1e-9,
) -> EdgeClassifier:
    """Weighted multinomial classifier; the regularisation that does best on validation wins, the first one if there is nothing to validate on.

    The solver goes on until a step gains less than ``tol``; ``trials`` has its steps, the largest entry of the gradient at its
    result (see ``classifier_gradient``) and the validation loss. Without training edges there is nothing to learn, which raises.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    labels = sorted(r[0] for r in train.select(label).distinct().collect())  # classes
    if not labels:
        raise ValueError("no training edges")
    if len(labels) == 1:
        return EdgeClassifier(None, labels, reg_params[0], [])
    code = F.array_position(F.lit(labels), F.col(label)) - 1
    weighted = train.withColumns({"_w": _class_weight(label, benign_weight, other_weight), "_code": code.cast("double")})
    tries = []
    for reg in reg_params:
        model = LogisticRegression(
            featuresCol=features, labelCol="_code", weightCol="_w", family="multinomial", regParam=reg, maxIter=max_iter, tol=tol
        ).fit(weighted)
        fitted = EdgeClassifier(model, labels, reg, [])
        own = F.coalesce(F.try_element_at(vector_to_array("probability"), (code + 1).cast("int")), F.lit(0.0))
        own = F.when(code < 0, 0.0).otherwise(own)
        loss = model.transform(validation).agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15))))).first()[0]
        gap = F.max(F.abs(F.col("expected") - F.col("observed")))
        gradient = classifier_gradient(train, fitted, features, label, benign_weight, other_weight).agg(gap).first()[0]
        tries.append((fitted, {"reg": reg, "steps": model.summary.totalIterations, "gradient": gradient, "validation_loss": loss}))
    best = min(tries, key=lambda t: float("inf") if t[1]["validation_loss"] is None else t[1]["validation_loss"])[0]
    return EdgeClassifier(best.model, labels, best.reg, [t for _, t in tries])
