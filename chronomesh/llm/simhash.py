"""SimHash fingerprints linked by covering locality-sensitive hashing.

A fingerprint bit is set if it is set in more than half of the 64-bit hashes of a text's word
shingles. Fingerprints link at ``radius`` or fewer differing bits. Every bit position gets a
random non-zero vector of ``radius + 1`` bits; for each of the ``2 ** (radius + 1) - 1`` non-zero
vectors v, mask v keeps the positions whose vector has odd parity against v. Any ``radius``
positions leave some v orthogonal to all their vectors, so a pair that differs only there agrees
on mask v: it meets in that table with certainty.

Only distinct fingerprints enter the tables, so copies cost nothing. A bucket of up to
``bucket_rows`` fingerprints is linked inside one row: each newly reached fingerprint is held
against the rest, and only a spanning set of links leaves the bucket. Fingerprints of larger
buckets take an exact way that is linear in their number: a pair differs in at most ``radius``
bits exactly if some point lies within half the radius (rounded down) of one and within the rest
of the other. Each fingerprint names the points around it, and a point that has a fingerprint
within the smaller distance ties together all that name it.

Defined results: a null or empty text has fingerprint zero, linked like any other; fewer words
than a shingle make one shingle; repeated rows give repeated result rows; an empty table stays
empty; a component's id is its smallest non-null document id (null if it has none).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.llm import kernels
from chronomesh.llm.components import components
from chronomesh.llm.store import staged, unused

SEED = 42
BITS = 64
BUCKET_ROWS = 4096


def fingerprint(text: bytes, size: int = 3) -> int:
    """SimHash of one text (UTF-8)."""
    words = text.lower().split()  # bytes: lower-cases A-Z only, splits at the ASCII white space
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(norm, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lengths + 1) - 1
    start = (end - lengths)[:len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(norm[a:b], SEED) for a, b in zip(start, end[size - 1:].tolist())), np.uint64, len(start))
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo:lo + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, *carried: Column) -> DataFrame:
    """(doc_id, carried columns, fp) of every row; fp holds the 64 bits as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *carried, F.col(text_col).alias("text"))
    names = rows.columns[:-1]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(t, size) for t in kernels.texts_of(batch.column(len(names)))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got.view(np.int64))], [*names, "fp"])

    return rows.mapInArrow(run, f"{kinds}, fp long")


def covering_masks(radius: int, seed: int = SEED) -> list[int]:
    """The masks as 64-bit numbers."""
    draw = random.Random(seed)
    vectors = [draw.randrange(1, 1 << (radius + 1)) for _ in range(BITS)]
    return [
        sum(1 << i for i, v in enumerate(vectors) if (v & chosen).bit_count() & 1) for chosen in range(1, 1 << (radius + 1))
    ]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def spanning_links(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever chains of pairs within the radius connect, at most one a point."""
    rest, out = points.view(np.uint64), []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            at, front = front[0], front[1:]
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                out.extend((int(at.view(np.int64)), int(x)) for x in rest[near].view(np.int64))
                front, rest = np.append(front, rest[near]), rest[~near]
    return out


def _link_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            values, ends = batch.column(0).flatten().to_numpy(zero_copy_only=False), None
            lengths = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            for lo, hi in zip((ends - lengths).tolist(), ends.tolist()):
                for x, y in spanning_links(values[lo:hi], radius):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _balls(radius: int):
    """Around each fingerprint, all points up to ceil(radius / 2) away, and how far away they are."""
    far = radius - radius // 2
    flips = [sum(1 << i for i in c) for d in range(far + 1) for c in combinations(range(BITS), d)]
    flip = np.array(flips, np.uint64)
    inner = np.bitwise_count(flip) <= radius // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for lo in range(0, len(points), 64):
                some = points[lo:lo + 64]
                yield pa.RecordBatch.from_arrays([
                    pa.array((some[:, None] ^ flip).ravel().view(np.int64)),
                    pa.array(np.repeat(some.view(np.int64), len(flip))),
                    pa.array(np.tile(inner, len(some))),
                ], ["hub", "fp", "inner"])

    return run


def near_links(points: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that join all pairs within the radius."""
    masks = [signed(m) for m in covering_masks(radius)]
    tables = F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)
    ])
    entries = points.select("fp", F.inline(tables))
    sizes = entries.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = staged(sizes, "bucket-sizes")
    placed = entries.join(sizes, ["mask", "key"])
    buckets = (
        placed.filter(F.col("n") <= bucket_rows).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        .select("fps").mapInArrow(_link_buckets(radius), "a long, b long")
    )
    crowded = placed.filter(F.col("n") > bucket_rows).select("fp").distinct()
    balls = staged(crowded.mapInArrow(_balls(radius), "hub long, fp long, inner boolean"), "balls")
    hubs = (
        balls.groupBy("hub").agg(F.min("fp").alias("least"), F.max("fp").alias("most"), F.max("inner").alias("inner"))
        .filter("inner and least < most").select("hub", "least")
    )
    around = balls.join(hubs, "hub").select(F.col("fp").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return buckets.unionByName(around).distinct()


def component_ids(prints: DataFrame, radius: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``prints`` (columns doc_id, fp)."""
    points = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = staged(components(near_links(points.select("fp"), radius, bucket_rows)), "roots")
    ids = points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    return staged(ids.join(least, "root").select("fp", "root", "component_id"), "component-ids")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id reachable over links."""
    prints = staged(fingerprints(docs, id_col, text_col, size), "fingerprints")
    return prints.join(component_ids(prints, radius, bucket_rows), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 3,
                         bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id.

    Of several rows with that id, or where no row of a component has an id, one row stays. The choice is
    made over ids and hashes of texts; the texts themselves are dealt out once, for the final selection.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    prints = staged(fingerprints(docs, id_col, text_col, size, text_hash.alias("text_hash")), "fingerprints")
    placed = prints.join(component_ids(prints, radius, bucket_rows), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = placed.groupBy("root", "component_id").agg(F.min("text_hash").alias("text_hash"))
    keys = unused(docs, "_none", "_id", "_text")
    chosen = staged(chosen.select(
        F.col("component_id").isNull().alias(keys[0]), F.coalesce(F.col("component_id").cast("string"), F.lit("")).alias(keys[1]),
        F.col("text_hash").alias(keys[2]),
    ).distinct(), "kept-documents")
    keyed = docs.select(
        "*", F.col(id_col).isNull().alias(keys[0]), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias(keys[1]),
        text_hash.alias(keys[2]),
    )
    return keyed.join(chosen, keys, "left_semi").dropDuplicates(keys).drop(*keys)
