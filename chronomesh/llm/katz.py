"""Katz backoff language model in tables: Good-Turing discounted counts, exactly normalised backoff weights.

A text's tokens are its lower-cased (A-Z) words and one end. A bigram's history is the word before
it, or the begin mark. With c the count in the training rows, N all training tokens, n_r the number
of n-grams seen r times, and d the Good-Turing discount (Katz, 1987; none above ``gt_max``)::

    p(w)     = d(c(w)) c(w) / N                    what is left goes to one class of unknown words
    p(w | h) = d(c(h,w)) c(h,w) / c(h)             for c(h,w) >= least
             = alpha(h) p(w)                       otherwise
    alpha(h) = (1 - sum of p(w' | h)) / (1 - sum of p(w'))     both over the followers w' with c(h,w') >= least

so every p(. | h) sums to 1 over the vocabulary and the unknown class. ``least`` = 2, the default, follows
Katz's own advice that bigrams met once be treated as unmet; they still make n_1, and hence the discounts. With
``least`` = 1, as in the query, every bigram that was met has its discounted probability. Where
nothing would be left for backing off, one more is added to the count that is divided by.

The model is one table of (order, h, w, c, p, alpha, total), partitioned by order: words with log10 p(w), log10 alpha(w)
and what counts are divided by after w, and bigrams with their counts. A text's score is a sum over its tokens of
log10 p(w) + log10 alpha(w), and, where the bigram is met, log10 p(w | h) - log10 alpha(h) - log10 p(w) on top, which
is the backoff recursion in the log domain.

Words are known by 64-bit hashes. The ``head_words`` most frequent ones are numbered by falling count; every task has their
numbers and counts. Bigrams travel and are merged in buckets, as columns of small numbers packed by byte planes; the number of buckets
follows the training tokens, so a bucket fits a task at any size, and a frequent history's bigrams are dealt over all of them.

Scoring needs a look-up per token. The frequent words and the ``head_bigrams`` most frequent bigrams are in every task; the rest,
rare words and rare bigrams that pass a Bloom filter of ``bloom_bits`` bits, meets the model's entries bucket by bucket.
All three are fixed sizes; with more data more goes to the buckets, with the same result. A row's number is its place
in its partition, so ``docs`` has to give the same rows in the same order when read again, as a scan of files does.

Defined results: null texts are empty and have the end as only token; repeated rows count and are
scored each; without training rows every token is of the unknown class and the score is 0; a null id
counts as the text ''; other columns pass through unread.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronomesh.llm import kernels
from chronomesh.llm.store import shared_folder, staged

#: Marks among the word hashes, and BEGIN's code. NO_HISTORY stands in the place of a history in entries of order 1.
BEGIN, END, NO_HISTORY = 1, 2, 0
GT_MAX, LEAST = 5, 2
HEAD_WORDS, HEAD_BIGRAMS, BLOOM_BITS = 1 << 20, 1 << 21, 1 << 27
#: Entries a task gathers before it hands them on, and training tokens a bucket.
GATHER = 1 << 21
#: Occurrences from which a history's bigrams are dealt over all buckets.
HOT = 1 << 18
_TAIL = np.uint64(1 << 63)
_ROWS = 1 << 18


def held_out(id_col: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds == fold


def token_pairs(words: kernels.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(history, token, text) of all tokens of a block; every text ends in END and starts after BEGIN."""
    total = len(words.start) + words.n
    token = np.full(total, END, np.uint64)
    token[np.arange(len(words.start)) + words.doc] = words.hash
    history = np.empty(total, np.uint64)
    history[1:] = token[:-1]
    history[words.first + np.arange(words.n)] = BEGIN
    return history, token, np.repeat(np.arange(words.n), words.count + 1)


def pair_key(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return kernels.mix(kernels.mix(history + np.uint64(0x9E3779B97F4A7C15)) + token)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins, in columns in which equal ones are neighbours."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])))


def _summed(h: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (h, w), ascending, with the sums of n."""
    order = np.lexsort((w, h))
    h, w, n = h[order], w[order], n[order]
    first = _runs(h, w)
    return h[first], w[first], np.add.reduceat(n, first) if len(first) else n


def pack(values: np.ndarray) -> bytes:
    """Eight-byte numbers as compressed byte planes: the planes of small numbers are zeros, which take no room."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, dtype: type = np.uint64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view(dtype).ravel()


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


class Lexicon:
    """Codes of words: the frequent ones are numbered by falling count from 2 on, the others keep their hash with the top bit set."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, cut: int):
        order = np.lexsort((hashes, -counts))
        ranked = np.append(np.uint64(BEGIN), hashes[order])
        by_hash = np.argsort(ranked)
        self.hash, self.code = ranked[by_hash], (by_hash + 1).astype(np.uint64)
        self.count = np.append([0, 0], counts[order])  # by code
        self.hot = np.uint64(1 + int((counts >= HOT).sum()))
        self.tail_hot = cut > HOT

    def codes(self, tokens: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hash, tokens), len(self.hash) - 1)
        return np.where(self.hash[at] == tokens, self.code[at], tokens | _TAIL)

    def pairs(self, words: kernels.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``token_pairs`` in codes; each distinct word of the block is looked up once."""
        h, w, doc = token_pairs(words)
        distinct, at = np.unique(w, return_inverse=True)
        w = self.codes(distinct)[at]
        starts = h == BEGIN
        h[1:] = w[:-1]
        h[starts] = BEGIN
        return h, w, doc

    def bucket(self, h: np.ndarray, w: np.ndarray, buckets: int) -> np.ndarray:
        """All bigrams of a history share a bucket, unless it is frequent: those are dealt out one by one."""
        split = (h <= self.hot) | (h >= _TAIL if self.tail_hot else False)
        return (np.where(split, pair_key(h, w), kernels.mix(h)) % np.uint64(buckets)).astype(np.int32)


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns of each bucket, rows in their order."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    first = _runs(bucket)
    for lo, hi in zip(first.tolist(), np.append(first[1:], len(bucket)).tolist()):
        yield int(bucket[lo]), [c[lo:hi] for c in columns]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, summed over as much as a task may hold at once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        w, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        _, w, n = _summed(np.zeros(len(w), np.uint64), w, n)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], ["w", "n"])

    size = 0
    for batch in batches:
        texts = kernels.texts_of(batch.column(0))
        for lo, hi in kernels.blocks(texts):
            words = kernels.Words(texts[lo:hi], lower=True)
            held += [np.unique(words.hash, return_counts=True), (np.array([END], np.uint64), np.array([words.n]))]
            size += len(held[-2][0])
            if size >= GATHER:
                yield flush()
                size = 0
    if held:
        yield flush()


def _count_pairs(lexicon: Broadcast, buckets: int):
    """Counts of bigrams, as much as a task may hold at once, in one packed row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, w, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            rows = [(b, pack(_steps(h)), pack(w), pack(n)) for b, (h, w, n) in _dealt(lexicon.value.bucket(h, w, buckets), h, w, n)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 3)], ["bucket", "h", "w", "n"])

        size = 0
        for batch in batches:
            texts = kernels.texts_of(batch.column(0))
            for lo, hi in kernels.blocks(texts):
                h, w, _ = lexicon.value.pairs(kernels.Words(texts[lo:hi], lower=True))
                held.append(_summed(h, w, np.ones(len(w), np.int64)))
                size += len(held[-1][0])
                if size >= GATHER:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigrams of each bucket with their counts; rows come bucket by bucket."""
    now, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            h, w, c = _summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            for lo in range(0, len(h), _ROWS):
                some = slice(lo, lo + _ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (h, w, c)], ["h", "w", "c"])

    for batch in batches:
        for bucket, h, w, n in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != now:
                yield from flush()
                now = bucket
            held.append((np.cumsum(unpack(h)), unpack(w), unpack(n, np.int64)))
    yield from flush()


def discounts(met: list[int]) -> list[float]:
    """Good-Turing discounts of the counts 1..k from n_1..n_(k+1); 1 where these give none between 0 and 1."""
    k = len(met) - 1
    out = [1.0] * k
    if met[0] and all(met):
        share = (k + 1) * met[k] / met[0]
        for r in range(1, k + 1):
            d = ((r + 1) * met[r] / (r * met[r - 1]) - share) / (1 - share) if share < 1 else 1.0
            out[r - 1] = d if 0 < d <= 1 else 1.0
    return out


def _discounted(c: Column, d: list[float]) -> Column:
    return c * F.coalesce(F.get(F.array(*[F.lit(x) for x in d]), (F.least(c, F.lit(len(d) + 1)) - 1).cast("int")), F.lit(1.0))


def _discounted_array(c: np.ndarray, d: list[float]) -> np.ndarray:
    return c * np.append(d, 1.0)[np.minimum(c, len(d) + 1) - 1]


@dataclass(frozen=True)
class Model:
    """``entries`` is the table of (order, h, w, c, p, alpha, total); the rest are a few numbers and the codes of the frequent words."""

    entries: DataFrame
    tokens: int
    vocabulary: int
    unknown: float
    begin: float
    starts: float
    buckets: int
    discount: list[float]
    lexicon: Broadcast


def _mass(lexicon: Broadcast, d1: list[float], d2: list[float], divisor: int):
    """(h, mass, lower) of what is side by side; a follower that has no number adds to ``lower`` by a join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = np.append([0.0, 0.0], _discounted_array(lexicon.value.count[2:], d1) / divisor)
        for batch in batches:
            h, w, c = (batch.column(i).to_numpy() for i in range(3))
            first = _runs(h)
            if len(first):
                lower = np.where(w < 0, 0.0, p[np.maximum(w, 0)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[first]), pa.array(np.add.reduceat(_discounted_array(c, d2), first)), pa.array(np.add.reduceat(lower, first)),
                ], ["h", "mass", "lower"])

    return run


_ENTRY = "h long, w long, c long, p double, alpha double, total double"


def fit(docs: DataFrame, text_col: str = "text", gt_max: int = GT_MAX, least: int = LEAST, head_words: int = HEAD_WORDS) -> Model:
    """The model of all rows of ``docs``."""
    spark, texts = docs.sparkSession, docs.select(F.col(text_col).alias("text"))
    seen, seen2 = Observation(), Observation()
    met = [F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, gt_max + 2)]
    words = staged(
        texts.mapInArrow(_count_words, "w long, n long").repartition("w").groupBy("w").agg(F.sum("n").alias("c"))
        .observe(seen, F.sum("c").alias("tokens"), F.count("*").alias("words"), *met), "katz-words")
    tokens, vocabulary = int(seen.get["tokens"] or 0), int(seen.get["words"] or 0)
    d1 = discounts([int(seen.get[f"n{r}"]) for r in range(1, gt_max + 2)])
    cut = _cut(words, head_words)
    head = words.filter(F.col("c") >= cut).toArrow()  # at most head_words rows
    lexicon = spark.sparkContext.broadcast(Lexicon(head["w"].to_numpy().view(np.uint64), head["c"].to_numpy(), cut))
    buckets = 1 << max(5, math.ceil(tokens / GATHER).bit_length())
    if not tokens:
        return Model(spark.createDataFrame([], f"order int, {_ENTRY}"), 0, 0, 0.0, 0.0, 1.0, buckets, [], lexicon)
    kept = words.agg(F.sum(_discounted(F.col("c"), d1))).first()[0]
    divisor = tokens if tokens - kept > 1e-9 * tokens else tokens + 1

    path = f"{shared_folder(spark)}/katz-model-{uuid.uuid4().hex}"
    counted = (
        texts.mapInArrow(_count_pairs(lexicon, buckets), "bucket int, h binary, w binary, n binary")
        .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merge_pairs, "h long, w long, c long")
        .observe(seen2, *met).filter(F.col("c") >= least)
    )
    counted.write.option("compression", "zstd").parquet(f"{path}/order=2")
    bigrams = spark.read.schema("h long, w long, c long").parquet(f"{path}/order=2")
    d2 = discounts([int(seen2.get[f"n{r}"]) for r in range(1, gt_max + 2)])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = lexicon.value.codes(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), batch.column(1)], ["w", "c"])

    words = words.mapInArrow(coded, "w long, c long").withColumn("p", _discounted(F.col("c"), d1) / divisor)
    rest = bigrams.filter("w < 0").join(words.filter("w < 0").select("w", "p"), "w").select("h", F.lit(0.0).alias("mass"), F.col("p").alias("lower"))
    sums = bigrams.mapInArrow(_mass(lexicon, d1, d2, divisor), "h long, mass double, lower double").unionByName(rest)
    sums = staged(sums.groupBy("h").agg(F.sum("mass").alias("mass"), F.sum("lower").alias("lower")), "katz-histories")
    # what is left for backing off: nothing only where all followers are frequent
    total = F.when(F.col("c") - F.col("mass") > 1e-9 * F.col("c"), F.col("c")).otherwise(F.col("c") + 1)
    alpha = F.log10((1 - F.col("mass") / F.col("total")) / (1 - F.col("lower")))
    first = (
        words.join(sums.withColumnRenamed("h", "w"), "w", "left").withColumn("total", total.cast("double"))
        .select(F.lit(NO_HISTORY).cast("long").alias("h"), "w", "c", F.log10("p").alias("p"),
                F.coalesce(alpha, F.lit(0.0)).alias("alpha"), "total")
    )
    first.write.parquet(f"{path}/order=1")
    entries = spark.read.schema(f"{_ENTRY}, order int").parquet(path)
    end = int(lexicon.value.codes(np.array([END], np.uint64)).view(np.int64)[0])
    texts_met = entries.filter((F.col("order") == 1) & (F.col("w") == end)).first()["c"]
    begin = (
        sums.filter(F.col("h") == BEGIN).withColumn("c", F.lit(texts_met)).withColumn("total", total.cast("double"))
        .select("total", alpha.alias("alpha")).first()
    )
    return Model(entries, tokens, vocabulary, float(np.log10(1 - kept / divisor)), begin["alpha"] if begin else 0.0,
                 begin["total"] if begin else 1.0, buckets, d2, lexicon)


def _cut(entries: DataFrame, most: int) -> int:
    """The lowest power of two that at most ``most`` entries reach with their count."""
    sizes = {r["b"]: r["n"] for r in entries.groupBy(F.floor(F.log2("c")).alias("b")).agg(F.count("*").alias("n")).collect()}
    total, cut = 0, max(sizes, default=0) + 1
    while cut > 0 and total + sizes.get(cut - 1, 0) <= most:
        cut -= 1
        total += sizes.get(cut, 0)
    return 2 ** cut


def _bloom_places(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (key & mask).astype(np.int64), ((key >> np.uint64(32)) & mask).astype(np.int64)


def _bloom(entries: DataFrame, bits: int) -> np.ndarray:
    """Bloom filter of the bigrams of ``entries``: as many bits whatever their number. Each task fills one of its own, which travels in packed pieces."""
    size = bits // 64
    piece = min(size, 1 << 15)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint64)
        for batch in batches:
            h, w = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            at = np.unique(np.concatenate(_bloom_places(pair_key(h, w), bits)))
            word = at >> 6
            first = _runs(word)
            if len(first):
                own[word[first]] |= np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)), first)
        rows = [(i, pack(own[i:i + piece])) for i in range(0, size, piece) if own[i:i + piece].any()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["start", "flags"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}  # as many pieces as the filter has, at most
        for batch in batches:
            for start, flags in zip(*(c.to_pylist() for c in batch.columns)):
                own[start] = own.get(start, np.uint64(0)) | unpack(flags)
        for start, flags in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([pack(flags)])], ["start", "flags"])

    kind, out = "start long, flags binary", np.zeros(size, np.uint64)
    got = entries.select("h", "w").mapInArrow(filled, kind).repartition("start").mapInArrow(merged, kind).toArrow()
    for start, flags in zip(got["start"].to_pylist(), got["flags"].to_pylist()):
        out[start:start + piece] = unpack(flags)
    return out


class Head:
    """What every scoring task holds: the frequent words' numbers by code, the frequent bigrams' values, and the filter for the others."""

    def __init__(self, model: Model, words: pa.Table, bigrams: pa.Table, bloom: np.ndarray, bits: int):
        code = words["w"].to_numpy()
        size = len(model.lexicon.value.count)
        self.count, self.p, self.alpha, self.total = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.ones(size)
        for own, name in ((self.count, "c"), (self.p, "p"), (self.alpha, "alpha"), (self.total, "total")):
            own[code] = words[name].to_numpy()
        self.alpha[BEGIN], self.total[BEGIN] = model.begin, model.starts
        self.log_total, self.discount = np.log10(self.total), model.discount
        h, w = (bigrams[x].to_numpy() for x in "hw")
        key = pair_key(h.view(np.uint64), w.view(np.uint64))
        order = np.argsort(key)
        self.bigram, self.bigram_value = key[order], self.value(h, w, bigrams["c"].to_numpy())[order]
        self.bloom, self.bits = bloom, bits

    def value(self, h: np.ndarray, w: np.ndarray, c: np.ndarray) -> np.ndarray:
        """What a met bigram of numbered words adds to a score beside its word and its history's weight."""
        return np.log10(_discounted_array(c, self.discount)) - self.log_total[h] - self.alpha[h] - self.p[w]

    @staticmethod
    def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted key, -1 if it is not there."""
        if not len(keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, at, -1)

    def maybe(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        for at in _bloom_places(key, self.bits):
            out &= (self.bloom[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return out


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, n).astype(np.float64)  # without entries it would be whole numbers


def _unique_rows(doc: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, history, token) and how often each occurs."""
    key = pair_key(h, w)
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    first = _runs(k, d)
    at = order[first]
    return doc[at], h[at], w[at], np.diff(np.append(first, len(k)))


_PACKED = "bucket int, side int, h binary, w binary, c binary, v binary"
_ANSWER = "home long, side int, rows binary, known binary, logs binary, values binary"
_QUERY, _OWN = 1, 2
#: Rows whose numbers agree beyond these bits are put together in one place.
_HOME = 16


def _pack_entries(lexicon: Broadcast, buckets: int):
    """Entries of the model in one packed row a bucket; v holds the values of entries with unnumbered words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            h, w, c = (table[x].to_numpy().view(np.uint64) for x in "hwc")
            v = table["v"].to_numpy() if "v" in table.column_names else np.empty(0)
            at = np.lexsort((w, h))
            h, w, c = h[at], w[at], c[at]
            columns = [h, w, c] + ([v[at]] if len(v) else [])
            rows = [(b, 0, pack(_steps(x[0])), *map(pack, x[1:]), *([] if len(v) else [None]))
                    for b, x in _dealt(lexicon.value.bucket(h, w, buckets), *columns)]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*rows), [pa.int32()] * 2 + [pa.binary()] * 4)], ["bucket", "side", "h", "w", "c", "v"])

        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= GATHER // 2:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          head_bigrams: int = HEAD_BIGRAMS, bloom_bits: int = BLOOM_BITS) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row."""
    spark, lexicon, buckets = docs.sparkSession, model.lexicon, model.buckets
    words, bigrams = model.entries.filter("order = 1"), model.entries.filter("order = 2").select("h", "w", "c")
    numbered = bigrams.filter("h >= 0 and w >= 0")
    cut = _cut(numbered, head_bigrams)
    rest = bigrams.filter((F.col("h") < 0) | (F.col("w") < 0) | (F.col("c") < cut))
    head = spark.sparkContext.broadcast(Head(
        model, words.filter("w >= 0").select("w", "c", "p", "alpha", "total").toArrow(),
        numbered.filter(F.col("c") >= cut).toArrow(), _bloom(rest, bloom_bits), bloom_bits,
    ))
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind, begin, unknown = pair.schema["doc_id"].dataType.simpleString(), model.begin, model.unknown
    own = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double"
    own_names, packed_names = ["row", "doc_id", "n_tokens", "n_known", "base", "score"], ["bucket", "side", "h", "w", "c", "v"]
    id_kind = to_arrow_type(pair.schema["doc_id"].dataType)
    own_kinds = [pa.int64(), id_kind, pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    answer_names = ["home", "side", "rows", "known", "logs", "values"]
    answer_kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    packed_kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lex, row, held = head.value, lexicon.value, TaskContext.get().partitionId() << 33, []

        def flush() -> pa.RecordBatch:
            h, w, n, rows = (np.concatenate(x) for x in zip(*held))
            held.clear()
            at = np.lexsort((w, h))
            h, w, n, rows = h[at], w[at], n[at], rows[at]
            out = [(b, _QUERY, pack(_steps(h)), pack(w), pack(n), pack(r)) for b, (h, w, n, r) in _dealt(lex.bucket(h, w, buckets), h, w, n, rows)]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(zip(*out), packed_kinds)] + [pa.nulls(len(out), k) for k in own_kinds],
                packed_names + own_names)

        size = 0
        for batch in batches:
            texts = kernels.texts_of(batch.column(1))
            for lo, hi in kernels.blocks(texts):
                h, w, doc = lex.pairs(kernels.Words(texts[lo:hi], lower=True))
                n, key, known = hi - lo, pair_key(h, w), w < _TAIL
                common = w[known].astype(np.int64)
                value = _sums(doc[known], (found.p + found.alpha)[common], n) + begin
                base = _sums(doc[known], np.log10(found.count + 1.0)[common], n)
                rare = _unique_rows(doc[~known], np.zeros(int((~known).sum()), np.uint64), w[~known])
                at = found.find(found.bigram, key)
                settled = at >= 0
                value += _sums(doc[settled], found.bigram_value[at[settled]], n)
                open_ = np.flatnonzero(~settled)
                open_ = open_[found.maybe(key[open_])]
                more = _unique_rows(doc[open_], h[open_], w[open_])
                rows = row + np.arange(n)
                row += n
                for d, *columns in (rare, more):
                    held.append((*columns, rows[d]))
                    size += len(d)
                sums = [rows, batch.column(0).slice(lo, n), kernels.per_text(n, doc), kernels.per_text(n, doc, known), base, value]
                spread = kernels.mix(rows.astype(np.uint64)) % np.uint64(buckets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread.astype(np.int32)), pa.array(np.full(n, _OWN, np.int32)), *[pa.nulls(n, pa.binary())] * 4]
                    + [x if isinstance(x, pa.Array) else pa.array(x) for x in sums], packed_names + own_names)
                if size >= GATHER // 2:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries of a bucket come before what is asked of it; a row's own sums pass through."""
        found, now, held, keys, counts, values = head.value, None, [], None, None, None
        for batch in batches:
            side = batch.column(1).to_numpy()
            mine = batch.filter(pa.array(side == _OWN)).select(own_names)
            if mine.num_rows:
                yield pa.RecordBatch.from_arrays([
                    pa.array(mine.column(0).to_numpy() >> _HOME), pa.array(np.zeros(mine.num_rows, np.int32)),
                    *[pa.nulls(mine.num_rows, pa.binary())] * 4, *mine.columns], answer_names + own_names)
            for bucket, kind_, h, w, c, v in zip(*(x.to_pylist() for x in batch.filter(pa.array(side != _OWN)).columns[:6])):
                if bucket != now:
                    now, held, keys = bucket, [], None
                h, w = np.cumsum(unpack(h)), unpack(w)
                if kind_ != _QUERY:
                    c = unpack(c, np.int64)
                    held.append((pair_key(h, w), c, found.value(h.view(np.int64), w.view(np.int64), c) if v is None else unpack(v, np.float64)))
                    continue
                if keys is None:
                    keys, counts, values = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.uint64), *[np.empty(0)] * 2)
                    order = np.argsort(keys)
                    keys, counts, values = keys[order], counts[order], values[order]
                n, rows = unpack(c, np.int64), unpack(v, np.int64)
                at, rare = found.find(keys, pair_key(h, w)), h == NO_HISTORY
                hit = at >= 0
                met_count, met_value = np.zeros(len(h)), np.where(rare, unknown, 0.0)
                met_count[hit], met_value[hit] = counts[at[hit]], values[at[hit]]
                which, slot = np.unique(rows, return_inverse=True)
                sums = [np.bincount(slot, n * x, len(which)) for x in (rare & hit, np.where(rare, np.log10(met_count + 1.0), 0.0), met_value)]
                some = reduce(np.logical_or, [x != 0 for x in sums])
                out = [(home, 1, pack(_steps(r.view(np.uint64))), *map(pack, x))
                       for home, (r, *x) in _dealt(which[some] >> _HOME, which[some], *(x[some] for x in sums))]
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*out), answer_kinds)] + [pa.nulls(len(out), k) for k in own_kinds],
                        answer_names + own_names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the answers to their rows' own sums, which come before them."""
        now, held, rows, added = None, [], None, None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held)
                more = [0, 0.0, 0.0] if rows is None else [x[np.argsort(np.argsort(table["row"].to_numpy()))] for x in added]
                known, base, value = (table[name].to_numpy() + x for name, x in zip(("n_known", "base", "score"), more))
                yield pa.RecordBatch.from_arrays(
                    [table["doc_id"].combine_chunks(), table["n_tokens"].combine_chunks(), pa.array(known.astype(np.int64)), pa.array(base), pa.array(value)],
                    own_names[1:])

        for batch in batches:
            home = batch.column(0).to_numpy()
            first = _runs(home)
            for lo, hi in zip(first.tolist(), np.append(first[1:], len(home)).tolist()):
                if home[lo] != now:
                    yield from flush()
                    now, held, rows = home[lo], [], None
                part = batch.slice(lo, hi - lo)
                answers = part.column(1).to_numpy() == 1
                if not answers.all():
                    held.append(part.filter(pa.array(~answers)).select(own_names))
                for r, *sums in zip(*(x.to_pylist() for x in part.filter(pa.array(answers)).columns[2:6])):
                    if rows is None:
                        rows = np.sort(np.concatenate([x.column(0).to_numpy() for x in held]))
                        added = [np.zeros(len(rows)) for _ in range(3)]
                    at = np.searchsorted(rows, np.cumsum(unpack(r)).view(np.int64))
                    for total, x in zip(added, sums):
                        total[at] += unpack(x, np.float64)
        yield from flush()

    # entries with an unnumbered word are joined with what their value is made of
    names = words.select("w", "p", "alpha", "total")
    histories = names.select(F.col("w").alias("h"), F.col("alpha").alias("a"), F.col("total").alias("t"))
    histories = histories.unionByName(spark.createDataFrame([(BEGIN, float(model.begin), float(model.starts))], "h long, a double, t double"))
    tail = bigrams.filter("h < 0 or w < 0").join(names.select("w", "p"), "w").join(histories, "h").select(
        "h", "w", "c", (F.log10(_discounted(F.col("c"), model.discount)) - F.log10("t") - F.col("a") - F.col("p")).alias("v"))
    tail = tail.unionByName(words.filter("w < 0").select("h", "w", "c", (F.col("p") + F.col("alpha")).alias("v")))
    pack_entries = _pack_entries(lexicon, buckets)
    asked = pair.mapInArrow(look_up, f"{_PACKED}, {own}")
    entries = numbered.filter(F.col("c") < cut).mapInArrow(pack_entries, _PACKED).unionByName(tail.mapInArrow(pack_entries, _PACKED))
    settled = (
        asked.unionByName(entries, allowMissingColumns=True)
        .repartition("bucket").sortWithinPartitions("bucket", "side").mapInArrow(settle, f"{_ANSWER}, {own}")
        .repartition("home").sortWithinPartitions("home", "side").mapInArrow(gather, own.removeprefix("row long, "))
    )
    share = float(np.log10(model.tokens + model.vocabulary + 1))
    return settled.select("doc_id", "n_tokens", "n_known", (F.col("base") - F.col("n_tokens") * F.lit(share)).alias("base_score"), "score")


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2,
                  least: int = LEAST, head_words: int = HEAD_WORDS, **scoring: int) -> DataFrame:
    """Fit on the rows outside the held-out fold, score all rows."""
    model = fit(docs.filter(~held_out(F.col(id_col), folds, fold)), text_col, least=least, head_words=head_words)
    scored = score(docs, model, id_col, text_col, **scoring)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
