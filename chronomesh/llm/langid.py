"""Language of every text, by a bidirectional gated recurrent network over its bytes.

A whole text is cut into windows of ``window`` bytes. The network (``bigru``) labels every position of every window with
language probabilities; a text's probabilities are their means over all its positions. So each byte counts once, whatever
the length of the text, and what a position sees is its window.

The network is fitted by backpropagation through time in one task, on a bounded sample: about ``per_language`` texts of each of
the ``languages`` most frequent languages, drawn by a hash, of each at most ``per_text`` windows spread evenly over the text;
windows are drawn from it in a fixed order, as many for each language. Everything else reads all rows.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text where no language could be
learned; with one learned language its score is 1; ties go to the language that sorts first; rows without language are not
learned from; repeated ids and rows are scored each; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.llm import bigru, kernels

HIDDEN, WINDOW, STEPS, BATCH, RATE = 8, 64, 250, 256, 0.02
PER_LANGUAGE, PER_TEXT, LANGUAGES = 400, 16, 256
#: Windows the network labels at once.
TOGETHER = 2048
NONE = "und"
_GRAIN = 1 << 30


@dataclass(frozen=True)
class Model:
    languages: list[str]
    network: bigru.Network | None
    window: int


def cut(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end) of all windows, and of what they index: the texts one after the other."""
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    end = np.cumsum(size)
    count = -(-size // window)
    doc = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return doc, (end - size)[doc] + place * window, end[doc]


def columns(data: np.ndarray, start: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """(positions x windows) bytes, filled up with ``PAD`` behind a text's end."""
    at = start + np.arange(window)[:, None]
    x = data[np.minimum(at, len(data) - 1)].astype(np.int16)
    x[at >= end] = bigru.PAD
    return x


def spread(text: bytes, window: int, most: int) -> bytes:
    """At most ``most`` windows of a text, evenly spread, one after the other; only the last may be short."""
    count = -(-len(text) // window)
    chosen = np.unique(np.linspace(0, count - 1, min(most, count)).astype(np.int64)) if count else []
    return b"".join(text[k * window:(k + 1) * window] for k in chosen)


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, train: Column, window: int, per_language: int,
            per_text: int, languages: int) -> tuple[list[str], DataFrame]:
    """The languages, and (label, h, part) of about twice ``per_language`` texts each."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & train)
    counts = known.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    counts = sorted((r["lang"], r["n"]) for r in counts)  # at most `languages` rows
    shares = [(label, lang, int(min(1.0, 2 * per_language / n) * _GRAIN)) for label, (lang, n) in enumerate(counts)]
    marked = docs.sparkSession.createDataFrame(shares, "label int, lang string, share long")
    h = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = (
        known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
        .join(F.broadcast(marked), "lang").filter(F.pmod("h", F.lit(_GRAIN)) < F.col("share")).select("label", "h", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [spread(t, window, per_text) for t in kernels.texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], ["label", "h", "part"])

    parts = rows.mapInArrow(run, "label int, h long, part binary")
    return [lang for lang, _ in counts], parts.groupBy("label", "part").agg(F.min("h").alias("h"))  # one of each group of copies


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hidden: int = HIDDEN,
        window: int = WINDOW, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, per_language: int = PER_LANGUAGE,
        per_text: int = PER_TEXT, languages: int = LANGUAGES) -> Model:
    """The network learned from the rows for which ``train`` holds."""
    names, sample = _sample(docs, id_col, text_col, lang_col, train, window, per_language, per_text, languages)
    if len(names) < 2:
        return Model(names, None, window)
    shapes = [a.shape for a in bigru.fresh(hidden, len(names), np.random.default_rng(0)).arrays]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: list[list[bytes]] = [[] for _ in names]
        for rows in batches:
            for label, part in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist()):
                if len(pools[label]) < per_language:
                    pools[label].append(part)
        learned = [k for k, pool in enumerate(pools) if pool]
        windows = []
        for k in learned:
            _, start, end = cut(pools[k], window)
            windows.append(columns(np.frombuffer(b"".join(pools[k]), np.uint8), start, end, window))
        draw = np.random.default_rng(0)
        net = bigru.fresh(hidden, len(names), draw)
        label = np.array(learned)[np.arange(batch) % len(learned)]

        def batch_of() -> np.ndarray:
            x = np.empty((window, batch), np.int16)
            for i in range(len(learned)):
                mine = np.arange(i, batch, len(learned))
                x[:, mine] = windows[i][:, draw.integers(windows[i].shape[1], size=len(mine))]
            return x

        bigru.train(net, [(batch_of(), label) for _ in range(steps)], rate)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(net.arrays)), pa.int32()), pa.array([a.tobytes() for a in net.arrays], pa.binary())], ["k", "data"])

    rows = sample.select("label", "h", "part").repartition(1).sortWithinPartitions("label", "h", "part")
    got = sorted(rows.mapInArrow(learn, "k int, data binary").collect(), key=lambda r: r["k"])  # the network's few arrays
    arrays = [np.frombuffer(bytes(r["data"]), np.float32).reshape(shape) for r, shape in zip(got, shapes)]
    return Model(names, bigru.Network((bigru.Unit(*arrays[:2]), bigru.Unit(*arrays[2:4])), *arrays[4:]), window)


def probabilities(texts: list[bytes], labeller: bigru.Labeller, window: int) -> np.ndarray:
    """(texts x labels): the means of the positions' probabilities; 0 for an empty text."""
    labels = len(labeller.bias)
    sums, data = np.zeros((labels, len(texts))), np.frombuffer(b"".join(texts), np.uint8)
    doc, start, end = cut(texts, window)
    for lo in range(0, len(doc), TOGETHER):
        part = slice(lo, lo + TOGETHER)
        x = columns(data, start[part], end[part], window)
        p = labeller(x)
        p *= x != bigru.PAD
        for k, per_window in enumerate(p.sum(axis=1, dtype=np.float64)):
            sums[k] += np.bincount(doc[part], per_window, len(texts))
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return (sums / np.maximum(size, 1)).T


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    text = F.col(text_col)
    pair = docs.select(F.col(id_col).alias("doc_id"), F.when(text.rlike(r"\p{L}"), text).alias("text"))
    if model.network is None:
        only = F.lit(model.languages[0] if model.languages else None).cast("string")
        known = F.col("text").isNotNull() & only.isNotNull()
        return pair.select("doc_id", F.when(known, only).otherwise(NONE).alias("lang_pred"), F.when(known, 1.0).otherwise(0.0).alias("score"))
    kind = pair.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = bigru.Labeller(model.network)
        for batch in batches:
            texts, names, scores = kernels.texts_of(batch.column(1)), [], []
            for lo, hi in kernels.blocks(texts):
                p = probabilities(texts[lo:hi], labeller, model.window)
                best = p.argmax(axis=1)
                scores.append(np.clip(p[np.arange(hi - lo), best], 0.0, 1.0))
                names += [model.languages[k] if texts[lo + i] else NONE for i, k in enumerate(best)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.empty(0))],
                ["doc_id", "lang_pred", "score"])

    return pair.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def _fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def fit_and_predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5,
                    fold: int = 0, **fitting: float) -> DataFrame:
    """Learn from the rows outside the held-out fold, predict all rows. A null id counts as the text ''."""
    model = fit(docs, _fold(F.col(id_col), folds) != fold, id_col, text_col, lang_col, **fitting)
    found = predict(docs, model, id_col, text_col)
    return found.select("doc_id", (_fold(F.col("doc_id"), folds) == fold).alias("held_out"), "lang_pred", "score")
