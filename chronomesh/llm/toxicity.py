"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs with one word between
(lower-cased, punctuation aside), hashed into ``2 ** bits`` coordinates. FTRL-proximal (McMahan et al., 2013)
gives every coordinate its own learning rate and, by its L1 term, keeps all but the telling ones at
exactly zero, so the weights are a few pairs that are broadcast; there can never be more than ``2 ** bits``.

The fit uses a sample of about ``max_rows`` labelled documents, drawn by a hash of the id, and runs ``epochs``
passes over it in a fixed order. FTRL is sequential, so one task does this; what it holds is the distinct
features of the sample, four bytes each. Scoring covers all texts.

Defined results: null texts are empty, and their score is that of the bias alone; labels without id or
label are not used, a document with several labels is toxic if one says so; of repeated ids among the
training documents one text is learned from; without labels every score is 0.5; ties in the sample's
order are broken by id; other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.llm import kernels

BITS, MAX_ROWS, EPOCHS = 20, 20_000, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3
BIAS = 0


def features(words: kernels.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every feature, repeats included; coordinate 0 is the bias."""
    h, doc = words.hash, words.doc
    mask = np.uint64((1 << bits) - 1)
    docs, keys = [doc], [h]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            keys.append(kernels.mix(h[:-gap] * np.uint64(2 * gap + 1) + h[gap:])[same])
    key = np.concatenate(keys) & mask
    return np.concatenate(docs), np.maximum(key.astype(np.int64), 1)


class Ftrl:
    """Per-coordinate state of FTRL-proximal with L1 and L2."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == BIAS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One text: distinct coordinates, each of value 1."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


def _fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def sample_of(labels: DataFrame, id_col: str, label_col: str, train: Column, max_rows: int) -> DataFrame:
    """(id, label) of about ``max_rows`` labelled ids for which ``train`` holds."""
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & train)
        .groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    )
    total = known.count()
    share = min(1.0, max_rows / total) if total else 1.0
    return known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train: Column, bits: int = BITS,
        max_rows: int = MAX_ROWS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA,
        l1: float = L1, l2: float = L2) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight, ascending, and their weights."""
    sample = sample_of(labels, id_col, label_col, train, max_rows)
    rows = (
        docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .join(F.broadcast(sample), "id")  # about max_rows ids
        .groupBy("id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
        .repartition(1).sortWithinPartitions(F.xxhash64("id"), "id")  # about max_rows texts
    )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = Ftrl(1 << bits, alpha, beta, l1, l2), []
        for batch in batches:
            texts, label = kernels.texts_of(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in kernels.blocks(texts):
                doc, at = features(kernels.Words(texts[lo:hi], lower=True, space=kernels.BREAK), bits)
                key = np.unique(doc << bits | at)
                cut = np.searchsorted(key, np.arange(hi - lo + 1) << bits)
                held += [
                    (np.append(BIAS, key[cut[i]:cut[i + 1]] & ((1 << bits) - 1)).astype(np.int32), label[lo + i])
                    for i in range(hi - lo)
                ]
        for _ in range(epochs):
            for at, y in held:
                model.learn(at, y)
        every = np.flatnonzero(model.n)
        w = model.weights(every)
        yield pa.RecordBatch.from_arrays([pa.array(every[w != 0]), pa.array(w[w != 0])], ["at", "w"])

    learned = rows.select("text", "label").mapInArrow(learn, "at long, w double").toArrow()  # at most 2 ** bits rows
    return learned["at"].to_numpy(), learned["w"].to_numpy()


def score(docs: DataFrame, coordinates: np.ndarray, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
          bits: int = BITS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((coordinates, weights))
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pair.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        table = np.zeros(1 << bits)
        table[at] = w
        for batch in batches:
            texts, scores = kernels.texts_of(batch.column(1)), []
            for lo, hi in kernels.blocks(texts):
                doc, found = features(kernels.Words(texts[lo:hi], lower=True, space=kernels.BREAK), bits)
                telling = table[found] != 0
                key = np.unique(doc[telling] << bits | found[telling])
                sums = np.bincount(key >> bits, table[key & ((1 << bits) - 1)], hi - lo).astype(float) + table[BIAS]
                scores.append(1 / (1 + np.exp(-np.clip(sums, -35, 35))))
            got = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got), pa.array((got >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return pair.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def fit_and_score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                  folds: int = 4, fold: int = 2, **fitting: float) -> DataFrame:
    """Fit on labelled rows outside the held-out fold, score all rows."""
    at, w = fit(docs, labels, id_col, text_col, label_col, _fold(F.col(id_col), folds) != fold, **fitting)
    scored = score(docs, at, w, id_col, text_col)
    return scored.select("doc_id", (_fold(F.col("doc_id"), folds) == fold).alias("held_out"), "score", "predicted")
