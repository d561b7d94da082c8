"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The vocabulary maps byte strings to ranks; a rank is also the token's id. A pre-token starts as a
linked list of its bytes. Each adjacent pair whose joined bytes have a rank lies in that rank's
bucket, and three levels of 64-bit words mark which buckets are filled, so that find-first-set
yields the next rank in three steps. A bucket gives its positions from left to right. Entries of
pairs that an earlier merge has changed are stale and skipped when they come up. The cost of a
pre-token is O(n log n) whatever its length. The unknown short pre-tokens of a block of texts go through
one queue together, so that a bucket is merged for all of them at once. Pre-tokens that are tokens, or were
met before, are looked up.

Defined results: a null or empty text has no token and decodes to the empty text; rows are
encoded one by one, so repeated rows are encoded alike; empty tables stay empty; columns besides
the text pass through unread.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm import kernels
from chronomesh.llm.store import unused

#: Pre-tokens a worker remembers before it forgets them all; it changes the speed only.
CACHE_ENTRIES = 250_000
#: Longer pre-tokens are not remembered.
CACHE_BYTES = 64
#: Text that is encoded together.
BLOCK_BYTES = 1 << 20
#: Unknown short pre-tokens that are merged together; the linked list takes some hundred bytes for each of these.
MERGE_BYTES = 128 << 10


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class RankQueue:
    """Buckets of positions by rank, with a bitmap of three levels over the filled buckets."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [at])
        else:
            heappush(bucket, at)

    def fill(self, rank: int, positions: list[int]) -> None:
        """Give an empty bucket its positions, in ascending order."""
        self.buckets[rank] = positions
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank with positions, by find-first-set on each level."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        """Empty a bucket."""
        self.low[rank >> 6] &= ~(1 << (rank & 63))
        if not self.low[rank >> 6]:
            self.mid[rank >> 12] &= ~(1 << (rank >> 6 & 63))
            if not self.mid[rank >> 12]:
                self.top &= ~(1 << (rank >> 12))
        return self.buckets.pop(rank)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position."""
        rank = self.first()
        bucket = self.buckets[rank]
        return rank, heappop(bucket) if len(bucket) > 1 else self.take(rank)[0]


class Codec:
    """Encoder and decoder for one vocabulary and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.find = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.same = {rank: rank for rank in ranks.values()}  # one number object a rank, however many pre-tokens are remembered
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[token[:k]] << 32 | ranks[token[k:]], rank)
            for token, rank in ranks.items() for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
        ]
        pairs.sort()
        self.pair_key, self.pair_rank = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 if their bytes are no token."""
        if not len(self.pair_key):  # bytes only
            return np.full(len(a), -1, np.int64)
        key = a << 32 | b
        slot = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[slot] == key, self.pair_rank[slot], -1)

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Token ids of one long pre-token, merge by merge."""
        ranks, queue, n = self.ranks, self.queue, len(piece)
        # the token at i covers piece[i:follow[i]]; before[i] is the token on its left
        follow, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        pair = array("q", [-1]) * n  # rank of the pair that starts at i; -1 where there is none
        for i in range(n - 1):
            rank = ranks.get(piece[i:i + 2])
            if rank is not None:
                pair[i] = rank
                queue.push(rank, i)
        while queue.top:
            rank, at = queue.pop()
            if pair[at] != rank:
                continue  # stale
            gone = follow[at]
            follow[at], pair[gone] = follow[gone], -1
            if follow[at] < n:
                before[follow[at]] = at
            for i in (before[at], at):
                if i >= 0:
                    found = ranks.get(piece[i:follow[follow[i]]], -1) if follow[i] < n else -1
                    pair[i] = found
                    if found >= 0:
                        queue.push(found, i)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:follow[i]]])
            i = follow[i]
        return tuple(out)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Token ids of each of many short pre-tokens. All of them share the linked list, in which nothing follows a pre-token's last byte."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data, stop = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths)
        n = len(data)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        nothing = 0xFFFFFFFF  # a token of no pair
        token = np.append(self.byte[data], nothing)
        follow, before = np.arange(1, n + 2), np.arange(-1, n)
        follow[stop - 1], before[stop - lengths] = n, n
        pair = np.append(self._joined(token[:n], token[follow[:n]]), -1)
        alive = np.ones(n + 1, bool)  # whether a token starts here
        order = np.argsort(pair[:n], kind="stable")
        order = order[np.searchsorted(pair[order], 0):]
        if len(order):
            ranks = pair[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, at in zip(ranks[np.append(0, cuts)].tolist(), np.split(order, cuts)):
                self.queue.fill(r, at.tolist())
        while self.queue.top:
            rank = self.queue.first()
            at = self.queue.take(rank)
            at = np.array(sorted(set(at)) if len(at) > 1 else at)
            at = at[pair[at] == rank]  # the others are stale
            if not len(at):
                continue
            if len(at) > 1:  # of each pre-token the leftmost, as its merge may make a pair of a lower rank
                again = owner[at[1:]] == owner[at[:-1]]
                if again.any():
                    self.queue.fill(rank, at[1:][again].tolist())
                    at = at[np.append(True, ~again)]
            gone = follow[at]
            after = follow[gone]
            follow[at], before[after], token[at], pair[gone], alive[gone] = after, at, rank, -1, False
            left = before[at]
            near = np.concatenate([left[left < n], at])
            pair[near] = found = self._joined(token[near], token[follow[near]])
            for r, i in zip(found.tolist(), near.tolist()):
                if r >= 0:
                    self.queue.push(r, i)
        ids = list(map(self.same.__getitem__, token[:n][alive[:n]].tolist()))
        ends = np.cumsum(np.bincount(owner[alive[:n]], minlength=len(pieces))).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends)]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Token ids of each text; unknown pre-tokens of all texts are merged together."""
        split, known, ranks = [self.find(t) for t in texts], self.known, self.ranks
        fresh = [p for p in set(chain.from_iterable(split)) if p not in known]
        if len(known) + len(fresh) > CACHE_ENTRIES:
            known = self.known = {}
            fresh = list(set(chain.from_iterable(split)))
        coded = [p.encode() for p in fresh]
        merging = []
        for piece, data in zip(fresh, coded):
            rank = ranks.get(data)
            if rank is None:
                merging.append((piece, data))
            else:
                known[piece] = (rank,)
        short = [(p, d) for p, d in merging if len(d) <= CACHE_BYTES]
        for lo, hi in kernels.blocks([d for _, d in short], MERGE_BYTES):
            known.update(zip([p for p, _ in short[lo:hi]], self.merge([d for _, d in short[lo:hi]])))
        known.update((p, self.merge_long(d)) for p, d in merging if len(d) > CACHE_BYTES)
        out = [list(chain.from_iterable(map(known.__getitem__, pieces))) for pieces in split]
        for piece in [p for p, d in merging if len(d) > CACHE_BYTES]:
            del known[piece]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[int, int, str], Codec] = {}


def shared_vocabulary(docs: DataFrame, path: str) -> Broadcast:
    """The rank file at ``path``, read on the driver (its size does not depend on the data) and sent to the executors."""
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def codec_of(shared: Broadcast, pattern: str) -> Codec:
    """The worker's codec for a broadcast vocabulary; workers live longer than tasks."""
    data = shared.value
    key = (zlib.crc32(data), len(data), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(parse_ranks(data), pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of each text in ``ids_col``, which gets a longer name where ``docs`` has such a column."""
    (ids_col,) = unused(docs, ids_col)
    shared, at = shared_vocabulary(docs, vocabulary), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            texts = kernels.texts_of(batch.column(at))
            for lo, hi in kernels.blocks(texts, BLOCK_BYTES):
                ids = codec.encode_all([t.decode() for t in texts[lo:hi]])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names, ids_col]
                )

    return docs.mapInArrow(run, f"{_ddl(docs)}, `{ids_col}` array<int>")


def _ddl(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)


def decode(tokens: DataFrame, vocabulary: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that each row's ids stand for in ``bytes_col``, which gets a longer name where ``tokens`` has such a
    column; null ids decode to nothing."""
    (bytes_col,) = unused(tokens, bytes_col)
    shared, at = shared_vocabulary(tokens, vocabulary), tokens.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [codec.decode(ids or []) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.binary())], [*part.schema.names, bytes_col])

    return tokens.mapInArrow(run, f"{_ddl(tokens)}, `{bytes_col}` binary")


def encode_checked(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, token_ids, exact) of every row; exact is whether the ids decode to the text."""
    shared = shared_vocabulary(docs, vocabulary)
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pair.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            texts = kernels.texts_of(batch.column(1))
            for lo, hi in kernels.blocks(texts, BLOCK_BYTES):
                ids = codec.encode_all([t.decode() for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                    pa.array([codec.decode(x) == t for x, t in zip(ids, texts[lo:hi])], pa.bool_()),
                ], ["doc_id", "n_tokens", "token_ids", "exact"])

    return pair.mapInArrow(run, f"doc_id {kind}, n_tokens long, token_ids array<int>, exact boolean")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: digests of the ids and of the bytes they decode to."""
    shared = shared_vocabulary(docs, vocabulary)
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pair.schema["doc_id"].dataType.simpleString()
    sha: Callable[[bytes], str] = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            texts = kernels.texts_of(batch.column(1))
            for lo, hi in kernels.blocks(texts, BLOCK_BYTES):
                for ids in codec.encode_all([t.decode() for t in texts[lo:hi]]):
                    counts.append(len(ids))
                    ids_sha.append(sha(" ".join(map(str, ids)).encode()))
                    text_sha.append(sha(codec.decode(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return pair.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
