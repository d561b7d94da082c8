import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.llm import bigru, langid
from tests.llm.conftest import SCHEMA, edge_rows

QUICK = {"steps": 40, "batch": 64, "hidden": 4}


def slow_labels(net, data):
    """The network on one window, position by position in plain numbers."""
    def run(unit, at):
        size = unit.across.shape[1]
        h, out = [0.0] * size, {}
        for t in at:
            over = [[sum(h[i] * float(unit.across[g, i, j]) for i in range(size)) for j in range(size)] for g in range(3)]
            add = unit.table[:, data[t]]
            z, r = ([1 / (1 + math.exp(-(float(add[g, j]) + over[g][j]))) for j in range(size)] for g in (0, 1))
            c = [math.tanh(float(add[2, j]) + r[j] * over[2][j]) for j in range(size)]
            h = out[t] = [c[j] + z[j] * (h[j] - c[j]) for j in range(size)]
        return out

    forth, back = run(net.units[0], range(len(data))), run(net.units[1], reversed(range(len(data))))
    p = []
    for t in range(len(data)):
        scores = (np.array(forth[t] + back[t]) @ net.out + net.bias).astype(float)
        e = np.exp(scores - scores.max())
        p.append(e / e.sum())
    return np.array(p)


def test_every_position_is_labelled_and_pooled():
    net = bigru.fresh(5, 3, np.random.default_rng(1))
    draw = random.Random(2)
    texts = [bytes(draw.randrange(256) for _ in range(n)) for n in (0, 1, 15, 16, 17, 100)]
    got = langid.probabilities(texts, bigru.Labeller(net), 16)
    for text, row in zip(texts, got):
        whole = []
        for lo in range(0, len(text), 16):
            part = text[lo:lo + 16]
            whole.append(slow_labels(net, list(part) + [bigru.PAD] * (16 - len(part)))[:len(part)])
        want = np.concatenate(whole).mean(axis=0) if whole else np.zeros(3)
        assert np.allclose(row, want, atol=1e-5)


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(3)
    net = bigru.fresh(3, 4, draw, np.float64)
    x = draw.integers(0, 6, (7, 5))
    x[5:, 0] = x[2:, 1] = bigru.PAD
    label = np.array([0, 1, 2, 3, 1])
    _, grads = bigru.gradients(net, x, label)
    for a, g in zip(net.arrays, grads):
        for flat in draw.integers(a.size, size=12).tolist() + [0, a.size - 1]:
            at = np.unravel_index(flat, a.shape)
            kept, step = a[at], 1e-6
            a[at] = kept + step
            up = bigru.gradients(net, x, label)[0]
            a[at] = kept - step
            down = bigru.gradients(net, x, label)[0]
            a[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 1e-7


def test_held_out_accuracy_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.fit_and_predict(docs, steps=150).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = got[got.held_out & got.lang.notna() & (got.text.str.len() > 40)]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert [h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(got.doc_id, got.held_out)].count(False) == 0


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(9)
    words = {lang: ["".join(draw.choice(letters) for _ in range(5)) for _ in range(60)] for lang, letters in (("xx", "abcdefgh"), ("yy", "rstuvwxyz"))}
    rows = [(i, " ".join(draw.choice(words[lang]) for _ in range(30)), lang, "s", 1, 0, "w", 0) for i in range(120) for lang in [("xx", "yy")[i % 2]]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def result(df):
    return sorted((r.doc_id, r.lang_pred, r.score) for r in df.collect())


def test_fixed_result_without_held_out_labels_ids_and_sources(spark, corpus):
    first = langid.fit_and_predict(corpus, **QUICK)
    assert first.filter("held_out").count() > 10
    truth = {r.doc_id: r.lang for r in corpus.collect()}
    assert np.mean([truth[d] == p for d, p, _ in result(first)]) > 0.97
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = corpus.repartition(2).withColumn("lang", F.when(fold, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert result(langid.fit_and_predict(turned, **QUICK)) == result(first)


def test_a_group_of_copies_does_not_crowd_out_a_language(spark, corpus):
    copies = spark.range(1000, 1400).select(
        F.col("id").alias("doc_id"), F.lit("abc bcd cde").alias("text"), F.lit("xx").alias("lang"), F.lit("s").alias("source"),
        F.lit(1).cast("long").alias("n_chars"), F.lit(0).alias("fp"), F.lit("w").alias("words"), F.lit(0).alias("__id"))
    got = langid.fit_and_predict(corpus.unionByName(copies), **QUICK).join(corpus.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97


def test_defined_results(spark, edge, empty, corpus):
    assert langid.fit_and_predict(empty, **QUICK).collect() == []
    only = langid.fit_and_predict(edge, **QUICK).collect()  # one language
    assert len(only) == len(edge_rows())
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in edge.collect() if r.doc_id not in (None, 3, 6)}
    for r in only:
        if r.doc_id in letters:
            assert (r.lang_pred, r.score) == (("en", 1.0) if letters[r.doc_id] else ("und", 0.0))
    none = langid.fit_and_predict(edge.withColumn("lang", F.lit(None).cast("string")), **QUICK)
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)}
    both = langid.fit_and_predict(edge.unionByName(corpus), **QUICK).collect()
    assert len(both) == len(edge_rows()) + 120 and all(r.score == 0 for r in both if r.lang_pred == "und")


def test_very_long_text(spark, corpus):
    long = corpus.filter("lang = 'yy'").limit(1).withColumn("text", F.repeat("text", 20_000)).withColumn("doc_id", F.lit(-5).cast("long"))
    got = langid.fit_and_predict(corpus.unionByName(long), **QUICK).filter("doc_id = -5").first()
    assert got.lang_pred == "yy"
