"""Quality rules as a short-circuit cascade.

Every rule is first run alone over a sample, which gives its cost (CPU seconds a text) and its
selectivity (share of texts it rejects). The cascade then runs the rules in descending order of
rejection per cost, each only over the texts that all earlier rules let through. A text is kept
if no rule rejects it, so the order decides what the run costs and never what it returns.

Defined results: a null or empty text has no word and is rejected by ``few_words``; rows are
judged one by one, so repeated rows and ties are judged alike; an empty table stays empty;
columns besides the text pass through unread, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm import kernels

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
#: Rows of the sample that rates the rules. It affects the order of the rules only.
SAMPLE_ROWS = 2000
#: Texts judged together; the counts of a block take many times its bytes.
BLOCK_BYTES = 1 << 19


class Block:
    """Counts of a block of texts, each computed when a rule first asks for it.

    After ``narrow`` further counts are computed for the remaining texts only.
    """

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self._words: kernels.Words | None = None
        self._known: dict[str, np.ndarray] = {}

    def narrow(self, keep: np.ndarray) -> Block:
        out = Block([self.texts[i] for i in np.flatnonzero(keep)])
        out._words = None if self._words is None else self._words.only(keep)
        out._known = {k: v[keep] for k, v in self._known.items()}
        return out

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    @property
    def words(self) -> kernels.Words:
        if self._words is None:
            self._words = kernels.Words(self.texts)
        return self._words

    def _n_words(self) -> np.ndarray:
        return self.words.count.astype(np.int64)

    def _sum_bytes(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.words.text_end] - sums[self.words.text_start]

    def _word_chars(self) -> np.ndarray:
        data = self.words.data
        return self._sum_bytes(~kernels.SPACE[data] & ((data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self._sum_bytes(SYMBOLS[self.words.data])

    def _lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every line with a word."""
        w = self.words
        end = np.flatnonzero(w.data == 10)
        start = np.append(0, end[:-1] + 1)
        filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)  # none in texts that are out
        start, end = start[filled], end[filled]
        return start, end, np.searchsorted(w.text_end, start, "right")

    def _n_lines(self) -> np.ndarray:
        return kernels.per_text(self.words.n, self._lines()[2])

    def _n_dup_lines(self) -> np.ndarray:
        start, end, doc = self._lines()
        _, later = kernels.repeated(doc, kernels.hash_runs(self.words.data, start, end))
        return kernels.per_text(self.words.n, doc, later)

    def _n_repeat_words(self) -> np.ndarray:
        w = self.words
        at, key = w.windows(WINDOW)
        every, _ = kernels.repeated(w.doc[at], key)
        change = np.zeros(len(w.start) + 1, np.int64)
        hit = at[every]
        np.add.at(change, hit, 1)
        np.add.at(change, hit + WINDOW, -1)
        return kernels.per_text(w.n, w.doc, np.cumsum(change)[:-1] > 0)


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps a block to a mask over its texts."""

    name: str
    rejects: Callable[[Block], np.ndarray]


def _few_words(b: Block) -> np.ndarray:
    return b["n_words"] < 20


def _repetition(b: Block) -> np.ndarray:
    return 100 * b["n_repeat_words"] > 30 * b["n_words"]


def _symbols(b: Block) -> np.ndarray:
    return 10 * b["n_symbols"] > b["n_words"]


def _word_length(b: Block) -> np.ndarray:
    return (b["word_chars"] < 2 * b["n_words"]) | (b["word_chars"] > 15 * b["n_words"])


def _dup_lines(b: Block) -> np.ndarray:
    return 2 * b["n_dup_lines"] > b["n_lines"]


#: The first two are the base rules; whatever fails one of them is never kept.
RULES = (
    Rule("few_words", _few_words),
    Rule("repetition", _repetition),
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("dup_lines", _dup_lines),
)


def rate_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
               sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[tuple[str, float, float]]:
    """(rule, CPU seconds a text, share rejected) of every rule, measured alone on a sample."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, n = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            texts = kernels.texts_of(batch.column(0))
            for lo, hi in kernels.blocks(texts, BLOCK_BYTES):
                n += hi - lo
                for i, rule in enumerate(rules):
                    began = time.thread_time()
                    rejected[i] += int(rule.rejects(Block(texts[lo:hi])).sum())
                    seconds[i] += time.thread_time() - began
        yield pa.RecordBatch.from_pydict({
            "rule": [r.name for r in rules], "n": [n] * len(rules), "rejected": rejected, "seconds": seconds,
        })

    total = docs.count()
    if not total:
        return [(r.name, 1.0, 0.0) for r in rules]
    sample = docs.select(F.col(text_col).alias("text")).sample(False, min(1.0, sample_rows / total), seed)
    rows = (
        sample.mapInArrow(rate, "rule string, n long, rejected long, seconds double")
        .groupBy("rule").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
        .collect()  # one row a rule
    )
    return [(r["rule"], r["seconds"] / max(r["n"], 1), r["rejected"] / max(r["n"], 1)) for r in rows]


def order_rules(rates: list[tuple[str, float, float]]) -> list[str]:
    """Names by rejection per cost, best first; ties by cost, then name."""
    return [r[0] for r in sorted(rates, key=lambda r: (-r[2] / max(r[1], 1e-12), r[1], r[0]))]


def run_cascade(block: Block, rules: list[Rule]) -> np.ndarray:
    """Mask over the block's texts that no rule rejects."""
    kept = np.arange(len(block.texts))
    for rule in rules:
        if not len(kept):
            break
        bad = rule.rejects(block)
        if bad.any():
            kept, block = kept[~bad], block.narrow(~bad)
    out = np.zeros(kept.max() + 1 if len(kept) else 0, bool)
    out[kept] = True
    return out


def _verdicts(texts: list[bytes], rules: list[Rule], counts: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    parts: dict[str, list[np.ndarray]] = {name: [] for name in (*counts, "kept")}
    for lo, hi in kernels.blocks(texts, BLOCK_BYTES):
        block = Block(texts[lo:hi])
        for name in counts:
            parts[name].append(block[name])
        kept = np.zeros(hi - lo, bool)
        mask = run_cascade(block, rules)
        kept[:len(mask)] = mask
        parts["kept"].append(kept)
    kinds = {"kept": bool}
    return {k: np.concatenate(v) if v else np.empty(0, kinds.get(k, np.int64)) for k, v in parts.items()}


def _ordered(docs: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[name] for name in order_rules(rate_rules(docs, text_col, rules))]


def quality_filter(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes every rule, with all their columns."""
    ordered, at = _ordered(docs, text_col, rules), docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _verdicts(kernels.texts_of(batch.column(at)), ordered)["kept"]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(keep, docs.schema)


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: its id, the base counts, and whether the cascade keeps it."""
    ordered = _ordered(docs, text_col, rules)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pair.schema["doc_id"].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = _verdicts(kernels.texts_of(batch.column(1)), ordered, counts)
            failed = (got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(got[c]) for c in counts), pa.array(failed), pa.array(got["kept"] & ~failed)],
                ["doc_id", *counts, "base_failed", "kept"],
            )

    fields = ", ".join(f"{c} long" for c in counts)
    return pair.mapInArrow(report, f"doc_id {kind}, {fields}, base_failed boolean, kept boolean")
