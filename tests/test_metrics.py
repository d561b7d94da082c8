import numpy as np
import math

import pytest
from pyspark.sql import functions as F

from chronomesh.operators import metrics


def brute_auroc(data):
    pos = [s for s, y in data if y == 1]
    neg = [s for s, y in data if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def brute_ap(data):
    total, out, last = sum(y for _, y in data), 0.0, 0.0
    if not total:
        return None
    for t in sorted({s for s, _ in data}, reverse=True):
        chosen = [y for s, y in data if s >= t]
        recall = sum(chosen) / total
        out += (recall - last) * sum(chosen) / len(chosen)
        last = recall
    return out


def test_rankings_with_ties_and_one_hot_group(spark):
    data = [(0, (i * 7 % 11) / 11, int(i * 13 % 5 < 2)) for i in range(400)]
    data += [(1, 0.5, 1), (1, 0.5, 0), (1, 0.9, 1), (2, 0.3, 0), (2, 0.4, 0), (3, 0.2, 1)]
    df = spark.createDataFrame(data, "batch int, score double, label int")
    got = {r["batch"]: r["auroc"] for r in metrics.auroc(df, ["batch"]).collect()}
    aps = {r["batch"]: r["average_precision"] for r in metrics.average_precision(df, ["batch"]).collect()}
    for b in range(4):
        mine = [(s, y) for x, s, y in data if x == b]
        for value, want in ((got[b], brute_auroc(mine)), (aps[b], brute_ap(mine))):
            assert (value is None) == (want is None)
            assert want is None or math.isclose(value, want)


def test_auroc_agrees_with_the_library_evaluator(spark, tiny):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from chronomesh.sources.views import pred

    df = pred(spark, tiny)
    ours = metrics.auroc(df, []).first()[0]
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
    assert math.isclose(ours, theirs, rel_tol=1e-9)


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.5, 1), (0.51, 1), (0.2, 0), (0.9, 0)], "score double, label int")
    r = metrics.stat_scores(df, [], F.col("score")).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"], r["support"]) == (1, 1, 1, 1, 2)
    m = metrics.binary_metrics(df, [], F.col("score")).first()
    assert (m["accuracy"], m["f1"]) == (0.5, 0.5)


def test_multiclass(spark):
    df = spark.createDataFrame([(0, [3.0, 1.0, 0.0]), (0, [0.0, 1.0, 0.5]), (1, [0.0, 2.0, 1.0]), (2, [5.0, 1.0, 1.0])], "label int, logits array<double>")
    r = metrics.multiclass_metrics(metrics.with_class(df), []).first()
    assert r["accuracy_micro"] == r["f1_micro"] == 0.5
    assert math.isclose(r["accuracy_macro"], (0.5 + 1 + 0) / 3) and math.isclose(r["f1_macro"], (0.5 + 2 / 3 + 0) / 3)
    cells = {(x["label"], x["pred"]): x["events"] for x in metrics.confusion_matrix(metrics.with_class(df), 3).collect()}
    assert len(cells) == 9 and sum(cells.values()) == 4 and cells[(2, 0)] == 1


def test_no_malicious_rows_gives_zero(spark):
    df = spark.createDataFrame([(0, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0])], "batch int, label int, logits array<double>")
    out = {r["batch"]: r["accuracy_micro"] for r in metrics.malicious_only_metrics(df, ["batch"]).collect()}
    assert out == {0: 0.0, 1: 1.0}


def test_losses(spark):
    df = spark.createDataFrame([(0, [2.0, 1.0], 0.5, 1), (1, [0.3, -1.0], -800.0, 0)], "label int, logits array<double>, x double, y int")
    ce = [math.log(sum(math.exp(z) for z in zs)) - zs[y] for y, zs in ((0, [2.0, 1.0]), (1, [0.3, -1.0]))]
    r = metrics.weighted_ce_loss(df, [], "logits", "label").first()
    assert math.isclose(r["class_loss"], (ce[0] + 5 * ce[1]) / 6) and math.isclose(r["plain_class_loss"], sum(ce) / 2)
    bce = metrics.bce_loss(df, [], "x", "y").first()[0]
    assert math.isclose(bce, math.log1p(math.exp(-0.5)) / 2)
    c = metrics.combined_losses(df, [], "logits", "label", "x", "y").first()
    assert math.isclose(c["loss_v2"], c["pred_loss"] * 0.5 + c["class_loss"] * 0.5)
    assert math.isclose(c["loss_alpha"], c["pred_loss"] * 1.2 + c["class_loss"])
    assert math.isclose(c["loss_observed"], c["pred_loss"] + 0.8 * sum(ce) / 2)


@pytest.mark.parametrize("share,floor", [(0.0, 0.2), (1.0, 1.0)])
def test_share_has_a_floor(spark, share, floor):
    df = spark.createDataFrame([(int(share), [0.0, 0.0], 0.0, 1)], "label int, logits array<double>, x double, y int")
    assert metrics.combined_losses(df, [], "logits", "label", "x", "y").first()["share"] == floor


@pytest.mark.parametrize("steps", [1, 2, 5, 9])
def test_running_auroc_against_one_ranking_a_step(spark, steps):
    draw = np.random.default_rng(steps)
    rows = [(g, int(draw.integers(steps)), float(draw.integers(6)), int(draw.integers(2))) for g in ("a", None) for _ in range(120)]
    rows += [("one", s, 0.5, 1) for s in range(steps)]
    df = spark.createDataFrame(rows, "g string, step int, score double, label int").repartition(5)
    got = {(r.g, r.step): r for r in metrics.ranking_over_time(df, ["g"], "step").collect()}
    assert len(got) == len({(r[0], r[1]) for r in rows})
    for (g, step), r in got.items():
        p = [x[2] for x in rows if x[0] == g and x[1] <= step and x[3] == 1]
        n = [x[2] for x in rows if x[0] == g and x[1] <= step and x[3] == 0]
        assert (r.positives, r.negatives) == (len(p), len(n))
        area = sum((a > b) + (a == b) / 2 for a in p for b in n)
        assert r.auroc == (pytest.approx(area / (len(p) * len(n))) if p and n else None)


def test_null_groups_keep_their_malicious_metrics(spark):
    rows = [(None, 1, [0.0, 5.0]), (None, 1, [0.0, 3.0]), ("b", 0, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "batch string, label int, logits array<double>")
    got = {r.batch: r for r in metrics.malicious_only_metrics(df, ["batch"]).collect()}
    assert got[None].accuracy_micro == 1.0 and got["b"].accuracy_micro == 0.0
