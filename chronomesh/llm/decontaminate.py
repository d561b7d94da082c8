"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

A test item's words (lower-cased, punctuation aside) give windows of ``seed_words`` words, and
every window is a seed, so each run of ``seed_words`` unchanged words holds one, however common
it is in the corpus. A seed that a document shares makes a candidate; the item is aligned to the
words around it (match 2, mismatch -1, gap -1), and the pair is a leak if the score reaches
``min_share`` of the score of an exact copy. A candidate whose matches alone, were they all in
order, would stay below that score is not aligned: it cannot reach it.

The benchmark is the stated query set. It is taken in blocks of at most ``block_bytes`` of text
(or one item, if longer), each broadcast and held against all documents.

Defined results: null texts are empty; an item without words matches nothing, one shorter than a
seed is its own seed; repeated items and rows give one result row for each distinct (row of the
documents, item id); empty tables give no leak; other columns pass through unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronomesh.llm import kernels

SEED_WORDS, MIN_SHARE = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_BYTES = 8 << 20
_FILTER_BITS = 22
#: Seed hits, once for each item that has the seed, that are laid out at a time, or those of one text.
_ENTRIES = 1 << 20


class Seeds:
    """Windows of a block of test items, and where each occurs in the items."""

    def __init__(self, texts: list[bytes], seed_words: int):
        words = kernels.Words(texts, lower=True, space=kernels.BREAK)
        self.size = words.count
        self.words = np.split(words.hash, np.cumsum(words.count)[:-1]) if len(texts) else []
        keys, items, at = [], [], []
        for item, own in enumerate(self.words):
            n = min(seed_words, len(own))
            if n:
                found = kernels.window_hash(own, n)
                keys.append(found)
                items.append(np.full(len(found), item))
                at.append(np.arange(len(found)))
        self.key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        self.item = np.concatenate(items) if items else np.empty(0, np.int64)
        self.at = np.concatenate(at) if at else np.empty(0, np.int64)
        self.sizes = sorted({min(seed_words, int(n)) for n in self.size if n})
        order = np.argsort(self.key, kind="stable")
        self.key, self.item, self.at = self.key[order], self.item[order], self.at[order]
        self.distinct, self.begin = np.unique(self.key, return_index=True)
        self.begin = np.append(self.begin, len(self.key))
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.distinct & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def hits(self, words: kernels.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position, index into ``distinct``) of every window of the texts that is a seed."""
        where, which = [], []
        for size in self.sizes:
            at, key = words.windows(size)
            maybe = self.filter[key & np.uint64((1 << _FILTER_BITS) - 1)]
            at, key = at[maybe], key[maybe]
            slot = np.minimum(np.searchsorted(self.distinct, key), len(self.distinct) - 1)
            found = self.distinct[slot] == key if len(key) else np.zeros(0, bool)
            where.append(at[found])
            which.append(slot[found])
        if not where:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(where), np.concatenate(which)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of ``item`` in ``words``, and the position after its last word."""
    steps = -GAP * np.arange(len(words) + 1, dtype=np.int64)
    above = np.zeros(len(words) + 1, np.int64)
    best, end = 0, 0
    for word in item:
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(row + steps) - steps  # gaps in the item
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def _regions(words: kernels.Words, seeds: Seeds) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, from, to): stretches of words to align an item with."""
    where, which = seeds.hits(words)
    order = np.argsort(words.doc[where], kind="stable")
    where, which = where[order], which[order]
    owner = words.doc[where]
    ends = np.append(np.flatnonzero(owner[1:] != owner[:-1]) + 1, len(owner))  # of each text's hits
    total = np.cumsum(np.diff(seeds.begin)[which])
    lo = 0
    while lo < len(where):
        most = _ENTRIES + (total[lo - 1] if lo else 0)
        text = max(int(np.searchsorted(total[ends - 1], most, "right")) - 1, int(np.searchsorted(ends, lo, "right")))
        hi = int(ends[text])
        yield from _regions_of(words, seeds, where[lo:hi], which[lo:hi])
        lo = hi


def _regions_of(words: kernels.Words, seeds: Seeds, where: np.ndarray, which: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    fan = np.diff(seeds.begin)[which]
    entry = np.repeat(seeds.begin[which], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    item, start = seeds.item[entry], np.repeat(where, fan) - seeds.at[entry]
    doc = np.repeat(words.doc[where], fan)
    order = np.lexsort((start, item, doc))
    doc, item, start = doc[order], item[order], start[order]
    slack = seeds.size[item] // 4 + 8
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (np.diff(start) > (seeds.size[item] + 2 * slack)[1:])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(doc)) - 1
    for a, b in zip(first.tolist(), last.tolist()):
        d, i, pad = int(doc[a]), int(item[a]), int(slack[a])
        lo, hi = int(words.first[d]), int(words.first[d] + words.count[d])
        yield d, i, max(lo, int(start[a]) - pad), min(hi, int(start[b]) + int(seeds.size[i]) + pad)


def leaks(texts: list[bytes], seeds: Seeds, min_share: float) -> list[tuple[int, int, int, float, int, int]]:
    """(text, item, score, share of the full score, first word, word after the last) of each leak."""
    words = kernels.Words(texts, lower=True, space=kernels.BREAK)
    best: dict[tuple[int, int], tuple[int, int, int, float, int, int]] = {}
    for d, i, lo, hi in _regions(words, seeds):
        item, part = seeds.words[i], words.hash[lo:hi]
        full = MATCH * len(item)
        if MATCH * int(np.isin(item, part).sum()) < min_share * full:
            continue
        score, end = align(item, part)
        if score >= min_share * full and score > best.get((d, i), (0, 0, 0))[2]:
            _, back = align(item[::-1], part[:end][::-1])
            origin = int(words.first[d])
            best[d, i] = (d, i, score, score / full, lo + end - back - origin, lo + end - origin)
    return sorted(best.values())


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of the test items, a bounded block at a time."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = math.ceil(total / block_bytes)
    for block in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).collect()
        rows.sort(key=lambda r: (str(r["item_id"]), r["text"] or ""))
        yield [r["item_id"] for r in rows], [(r["text"] or "").encode() for r in rows]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", seed_words: int = SEED_WORDS,
               min_share: float = MIN_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, share, start_word, end_word) of every leak: the best alignment of each pair."""
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_kind, item_kind = pair.schema["doc_id"].dataType, benchmark.schema[item_id_col].dataType
    schema = (
        f"doc_id {id_kind.simpleString()}, item_id {item_kind.simpleString()}, score long, share double, "
        "start_word long, end_word long"
    )
    out, arrow_kind = docs.sparkSession.createDataFrame([], schema), to_arrow_type(item_kind)
    for ids, texts in _blocks(benchmark, item_id_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Seeds(texts, seed_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, found = kernels.texts_of(batch.column(1)), []
                for lo, hi in kernels.blocks(of):
                    found += [(lo + d, ids[i], *rest) for d, i, *rest in leaks(of[lo:hi], shared.value, min_share)]
                best: dict[tuple, tuple] = {}  # an item may stand for several texts; they are in one block
                for row in found:
                    if row[:2] not in best or (row[2:4], best[row[:2]][4]) > (best[row[:2]][2:4], row[4]):
                        best[row[:2]] = row
                rows = list(best.values())
                column = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(column[0], pa.int64())), pa.array(column[1], arrow_kind),
                    pa.array(column[2], pa.int64()), pa.array(column[3], pa.float64()),
                    pa.array(column[4], pa.int64()), pa.array(column[5], pa.int64()),
                ], ["doc_id", "item_id", "score", "share", "start_word", "end_word"])

        out = out.unionByName(pair.mapInArrow(run, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", seed_words: int = SEED_WORDS,
               min_share: float = MIN_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no leak of any item, with all their columns."""
    at, out = docs.columns.index(text_col), docs
    for _, texts in _blocks(benchmark, item_id_col, item_text_col, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(Seeds(texts, seed_words))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                of, clean = kernels.texts_of(batch.column(at)), np.ones(batch.num_rows, bool)
                for lo, hi in kernels.blocks(of):
                    for d, *_ in leaks(of[lo:hi], shared.value, min_share):
                        clean[lo + d] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
