import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from chronomesh.operators import score
from chronomesh.plans import models


def edges(spark, n=400, labels=(0, 3, 7)):
    draw = np.random.default_rng(4)
    rows = [(labels[i % len(labels)], Vectors.dense(draw.standard_normal(3) * [1, 0.1, 5] + i % len(labels))) for i in range(n)]
    return spark.createDataFrame(rows, ["y", "features"])


def test_convergence_is_reported_and_labels_come_back(spark):
    df = edges(spark)
    fitted = score.fit_edge_classifier(df, df)
    assert fitted.labels == [0, 3, 7] and len(fitted.trials) == 2
    assert all(t["steps"] > 3 and t["gradient"] < 1e-5 for t in fitted.trials)
    assert fitted.reg == min(fitted.trials, key=lambda t: t["validation_loss"])["reg"]
    assert {r.prediction for r in fitted.transform(df).select("prediction").distinct().collect()} <= {0, 3, 7}


def test_gradient_shows_an_early_stop(spark):
    df = edges(spark)
    short = score.fit_edge_classifier(df, df, max_iter=2)
    assert max(t["gradient"] for t in short.trials) > 1e-4
    rows = score.classifier_gradient(df, short).collect()
    assert len(rows) == 3 * 4
    weight = {0: 1.0, 3: 5.0, 7: 5.0}
    data = [(r.y, [*r.features.toArray(), 1.0]) for r in df.collect()]
    total = sum(weight[y] for y, _ in data)
    for r in rows:
        assert r.observed == pytest.approx(sum(weight[y] * x[r.feature] for y, x in data if y == r.label) / total)


def test_stages_without_edges(spark):
    df = edges(spark)
    none = df.limit(0)
    with pytest.raises(ValueError, match="no training edges"):
        score.fit_edge_classifier(none, df)
    assert score.fit_edge_classifier(df, none).reg == 0.01
    one = score.fit_edge_classifier(df.filter("y = 3"), df)
    assert {r.prediction for r in one.transform(df).select("prediction").collect()} == {3}
    unseen = df.withColumn("y", F.when(F.col("y") == 7, 9).otherwise(F.col("y")))
    assert score.fit_edge_classifier(df, unseen).labels == [0, 3, 7]


def test_inputs_of_some_stages_are_those_of_all(spark, tiny):
    """The gradient needs no test batches, so they are not convolved."""
    every = models.classifier_inputs(spark, tiny).filter("stage < 2").select("conn_id", "piece", "stage", "features")
    some = models.classifier_inputs(spark, tiny, stages=(0, 1)).select("conn_id", "piece", "stage", "features")
    rows = lambda df: sorted((r.conn_id, r.piece, r.stage, tuple(np.round(r.features.toArray(), 9))) for r in df.collect())
    assert rows(some) == rows(every)
