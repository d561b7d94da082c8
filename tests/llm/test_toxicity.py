import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from chronomesh.llm import kernels, toxicity
from tests.llm.conftest import SCHEMA, edge_rows


def corpus(n=400):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        text, toxic = [draw.choice(words) for _ in range(80)], int(i % 5 == 0)
        for _ in range(3 * toxic):
            text[draw.randrange(80)] = draw.choice(["nastyone", "vilething"])
        rows.append((i, " ".join(text), None, None, None, None, None, None))
        labels.append((i, toxic))
    return rows, labels


def test_held_out_accuracy_and_fixed_result(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.fit_and_score(docs, marks).toPandas().merge(marks.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 60 and (held.predicted == held.toxic).mean() > 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    again = toxicity.fit_and_score(docs.repartition(2), marks.repartition(3)).toPandas().set_index("doc_id").score
    assert (again.loc[got.doc_id].to_numpy() == got.score.to_numpy()).all()


def test_held_out_labels_are_not_used(spark):
    rows, labels = corpus(200)
    docs = spark.createDataFrame(rows, SCHEMA)
    fold = {r.doc_id for r in toxicity.fit_and_score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect() if r.held_out}
    turned = [(d, 1 - t if d in fold else t) for d, t in labels]
    scores = [sorted(map(tuple, toxicity.fit_and_score(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_features():
    doc, at = toxicity.features(kernels.Words([b"A b, c", b"", b"a"], lower=True, space=kernels.BREAK), 20)
    assert np.bincount(doc, minlength=3).tolist() == [6, 0, 1]  # three words, two pairs, one skip
    assert len(set(at.tolist())) == 6  # "a" of both texts is one feature


def test_l1_keeps_rare_features_at_zero():
    model = toxicity.Ftrl(8, 1.0, 1.0, 8.0, 1.0)
    for i in range(100):
        model.learn(np.array([0, 1 if i % 2 else 2]), i % 2)
    model.learn(np.array([0, 3]), 1)
    w = model.weights(np.arange(8))
    assert w[1] > 0 > w[2] and w[3] == 0


def test_defined_results(spark, edge, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.fit_and_score(edge, none).collect()} == {0.5}
    some = spark.createDataFrame([(None, 1), (1, None), (6, 0), (6, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.fit_and_score(edge, some).count() == len(edge_rows())
    assert toxicity.fit_and_score(empty, some).collect() == []


def brute_scores(docs, labels, order, train, epochs):
    """FTRL-proximal over words, pairs and skips as plain tuples, one coordinate at a time."""
    def features(text):
        words = re.findall(r"[a-z0-9]+", text.lower())
        return ["bias", *sorted({(w,) for w in words} | {("", *p) for p in zip(words, words[1:])} | {("", "", *p) for p in zip(words, words[2:])})]

    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        l1 = 0.0 if f == "bias" else 0.5
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    def chance(text):
        return 1 / (1 + math.exp(-sum(weight(f) for f in features(text))))

    for _ in range(epochs):
        for d in order:
            if d in train:
                g = chance(docs[d]) - labels[d]
                for f, w in [(f, weight(f)) for f in features(docs[d])]:
                    z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w
                    n[f] += g * g
    return {d: chance(text) for d, text in docs.items()}


def test_scores_equal_brute_force(spark):
    draw = random.Random(3)
    docs = {i: " ".join(draw.choice(["Nasty", "fair", "blue", "sky", "vile", "tree", "river", "stone"]) for _ in range(12)) for i in range(60)}
    docs[60] = ""
    labels = {d: int("Nasty vile" in t or "vile Nasty" in t) for d, t in docs.items()}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    order = [r.doc_id for r in table.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    train = {d for d in docs if zlib.crc32(str(d).encode()) % 4 != 2}
    at, w = toxicity.fit(table, marks, "doc_id", "text", "toxic", toxicity._fold(F.col("doc_id"), 4) != 2, bits=22, epochs=3, l1=0.5)
    got = {r.doc_id: r.score for r in toxicity.score(table, at, w, bits=22).collect()}
    want = brute_scores(docs, labels, order, train, 3)
    assert 0 < sum(labels.values()) < len(docs) and len(at) > 8
    assert all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in docs)
