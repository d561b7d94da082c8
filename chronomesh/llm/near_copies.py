"""Near copies: documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

First candidates come from the covering tables of ``simhash`` over fingerprints of the same shingles, and,
because a similarity of 0.8 moves about ten of 64 fingerprint bits, from bands of minimum hashes as
well: 16 bands of 6 find a pair at 0.8 with probability 0.99, closer pairs more surely. Each
candidate is then held to the shingle sets themselves, so nothing is linked by an estimate.

What these miss is found exactly. Sets of a similarity t share a shingle among the first n - ceil(t n) + 1
of their n in any order that all sets follow (by hash; crowded and frequent shingles last). Points of different
classes that share as many of those as the threshold asks for, the first of them early enough, are held to their
sets too. Points that the first candidates have joined need no further pair, and the others of a large group
of copies meet by what few of them hold, not by what the whole group does, so it stays cheap here.

Rows with the same words are one point. A bucket of a band names no pairs one by one: its points, in
parts of about ``part_rows``, give the maximum spanning tree of their estimated similarities, cut
where the estimate lies far below the threshold. Such a tree links what any set of pairs above a
threshold links, and has fewer edges than points. The points of a large bucket that share most
buckets with others (the original, as a rule) are members of each of its parts and tie them together.

Defined results: words are those of ``simhash`` (A-Z lower-cased, ASCII white space between); a null
or empty text has no words, and all such rows are one point; fewer words than a shingle make one
shingle; repeated rows are one point; an empty table stays empty.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm import kernels, simhash
from chronomesh.llm.components import components
from chronomesh.llm.store import staged, unused

SIZE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 6
PART_ROWS = 1024
#: So many points of a large bucket, the best of as many even shares of it, are members of all its parts.
HUBS = 16
#: Estimates this far below the threshold are not looked at: over three standard errors of 96 minimum hashes.
MARGIN = 0.14
#: Shingles that so many points of several classes have among their first go behind all others; it changes the speed only.
CROWDED = 64
#: Shingles that more of the points with crowded ones hold go behind all others, too; speed only.
FREQUENT = 8
_draw = random.Random(simhash.SEED)
_FACTOR = np.array([_draw.getrandbits(64) | 1 for _ in range(BANDS * ROWS)], np.uint64)
_SHIFT = np.array([_draw.getrandbits(64) for _ in range(BANDS * ROWS)], np.uint64)


def shingle_hashes(words: list[bytes], size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; no words, no hashes."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    norm = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(norm, simhash.SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(lengths + 1) - 1
    start = (end - lengths)[:len(words) - size + 1].tolist()
    return np.unique(np.fromiter((digest(norm[a:b], simhash.SEED) for a, b in zip(start, end[size - 1:].tolist())), np.uint64, len(start)))


def _parts(similarity: float) -> tuple[int, int]:
    """The similarity as a fraction of whole numbers, so that no pair at the threshold hangs on rounding."""
    return Fraction(similarity).limit_denominator(10 ** 6).as_integer_ratio()


def _long(hashes: np.ndarray) -> np.ndarray:
    """The hashes as signed numbers in the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The upper 32 bits, in the same order: what points meet by. Two shingles that share them only name a pair too many."""
    return (_long(hashes) >> 32).astype(np.int32)


def first_length(n: int, similarity: float = SIMILARITY) -> int:
    """How many of the first shingles of a set of ``n`` hold one of any set of this similarity."""
    num, den = _parts(similarity)
    return n - -(-num * n // den) + 1 if n else 0


def minima(hashes: np.ndarray) -> np.ndarray:
    """The minimum of each keyed permutation (upper 32 bits); no hashes, the largest number."""
    out = np.full(len(_FACTOR), 0xFFFFFFFF, np.uint64)
    for lo in range(0, len(hashes), 2048):
        mixed = (hashes[lo:lo + 2048, None] * _FACTOR + _SHIFT) >> np.uint64(32)
        out = np.minimum(out, mixed.min(axis=0))
    return out.astype(np.uint32)


def _signed(x: int) -> int:
    return simhash.signed(x)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, rep, fp, bands, low, n, first) of every row: rep is the hash of its words, fp the SimHash
    fingerprint, bands the band keys, low the lower 16 bits of the minima, n the number of shingles, first the least hashes in short."""
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                reps, fps, keys, lows, counts, firsts = [], [], [], [], [], []
                for text in kernels.texts_of(part.column(2)):
                    words = text.lower().split()
                    hashes = shingle_hashes(words, size)
                    least = minima(hashes).astype("<u4")
                    counts.append(len(hashes))
                    firsts.append(_short(hashes[:first_length(len(hashes), similarity)]))
                    reps.append(_signed(xxhash.xxh64_intdigest(b" ".join(words), simhash.SEED)))
                    fps.append(_signed(simhash.fingerprint(text, size)))
                    keys.append([_signed(xxhash.xxh64_intdigest(row.tobytes(), i)) for i, row in enumerate(least.reshape(BANDS, ROWS))])
                    lows.append((least & 0xFFFF).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(reps, pa.int64()), pa.array(fps, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())), pa.array(lows, pa.binary()), pa.array(counts, pa.int64()), _lists(firsts),
                ], ["doc_id", "text_hash", "rep", "fp", "bands", "low", "n", "first"])

    kinds = f"doc_id {id_type}, text_hash long, rep long, fp long, bands array<long>, low binary, n long, first array<int>"
    return rows.mapInArrow(run, kinds)


def spanning_tree(low: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of the maximum spanning forest of the rows' shares of equal minima, those of ``least`` and more."""
    n, out = len(low), []
    best, source, open_ = np.full(n, -1), np.zeros(n, np.int64), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        open_[at] = False
        best[at] = -2
        agree = (low == low[at]).sum(axis=1)
        closer = open_ & (agree > best)
        best[closer], source[closer] = agree[closer], at
        at = int(best.argmax())
        if best[at] >= least * low.shape[1]:
            out.append((int(source[at]), at))
    return out


def _trees(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                points = dict(sorted((m["rep"], m["low"]) for m in members.as_py()))
                reps = list(points)
                low = np.frombuffer(b"".join(points.values()), "<u2").reshape(len(reps), -1)
                for x, y in spanning_tree(low, least):
                    a.append(reps[x])
                    b.append(reps[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def band_candidates(points: DataFrame, similarity: float = SIMILARITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Pairs (a, b) of points (columns rep, bands, low) that meet in a bucket of some band."""
    entries = points.select("rep", F.posexplode("bands").alias("band", "key"))
    sizes = staged(entries.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"), "band-sizes")
    placed = staged(entries.join(sizes, ["band", "key"]), "band-entries")
    parts = F.ceil(F.col("n") / part_rows)
    dealt = placed.select("band", "key", "rep", F.pmod(F.xxhash64("rep", "band"), parts).alias("part"))
    crowded = placed.filter(F.col("n") > part_rows)
    shared = placed.groupBy("rep").agg(F.sum("n").alias("shared"))
    hubs = (
        crowded.join(shared, "rep").groupBy("band", "key", "n", F.pmod(F.xxhash64("rep", F.lit("hub")), F.lit(HUBS)).alias("share"))
        .agg(F.max(F.struct("shared", "rep")).alias("hub"))
        .select("band", "key", F.col("hub.rep").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    )
    members = dealt.unionByName(hubs).join(points.select("rep", "low"), "rep")
    buckets = members.groupBy("band", "key", "part").agg(F.collect_list(F.struct("rep", "low")).alias("members"))
    return buckets.select("members").mapInArrow(_trees(similarity - MARGIN), "a long, b long")


def print_candidates(points: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of points (columns rep, fp) whose fingerprints the covering tables link, or that share one."""
    least = points.groupBy("fp").agg(F.min("rep").alias("b"))
    same = points.join(least, "fp").select(F.col("rep").alias("a"), "b")
    links = simhash.near_links(points.select("fp").distinct(), radius)
    one = least.select(F.col("fp").alias("x"), F.col("b").alias("a"))
    other = least.select(F.col("fp").alias("y"), "b")
    near = links.toDF("x", "y").join(one, "x").join(other, "y").select("a", "b")
    return same.unionByName(near)


def _sets(rows: DataFrame, size: int, of: Callable[[np.ndarray], np.ndarray] = _long, kind: str = "long") -> DataFrame:
    """(rep, hashes) of rows (rep, text): the shingle set as an ascending array of ``kind``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [of(shingle_hashes(t.lower().split(), size)) for t in kernels.texts_of(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(sets)], ["rep", "hashes"])

    return rows.mapInArrow(run, f"rep long, hashes array<{kind}>")


def verified(candidates: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The candidates (a, b) whose shingle sets (columns rep, hashes) have at least the similarity."""
    one = sets.select(F.col("rep").alias("a"), F.col("hashes").alias("one"))
    other = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("other"))
    both = candidates.join(one, "a").join(other, "b")
    common = F.size(F.array_intersect("one", "other")).cast("long")
    num, den = _parts(similarity)
    return both.filter(common * den >= (F.size("one") + F.size("other") - common) * num).select("a", "b")


def _met(known: DataFrame) -> DataFrame:
    """(token, m): first shingles that points of more than one class have, and how many points."""
    spread = known.select("cls", F.explode("first").alias("token"))
    met = spread.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("m"))
    return staged(met.filter("lo < hi").select("token", "m"), "first-shingles")


def _last(similarity: float):
    """The first shingles when some (column last) go behind the others, from the leading ones of all n; none where those are too few."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, reps, firsts = batch.slice(at, 128), [], []
                for rep, n, hashes, last in zip(*part.columns):
                    n, least = n.as_py(), first_length(n.as_py(), similarity)
                    own, last = (np.asarray(x.values, np.int32) for x in (hashes, last))
                    others = own[~np.isin(own, last)]
                    if len(others) >= least or len(own) == n:
                        reps.append(rep.as_py())
                        firsts.append(np.concatenate([others, last])[:least])
                if reps:
                    yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), _lists(firsts)], ["rep", "moved"])

    return run


def _dealt(bits: int):
    """The short hashes of the rows (hashes) by their upper ``bits``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = np.sort(np.asarray(batch.slice(at, 512).column(0).flatten(), np.int32))
                bucket = (own >> (32 - bits)).astype(np.int32)
                starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1))
                ends = np.append(starts, len(own)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.ListArray.from_arrays(pa.array(ends), pa.array(own))], ["bucket", "tokens"])

    return run


def _often(part: pa.Table) -> pa.Table:
    """(token, m): the numbers of one bucket that stand in it more than ``FREQUENT`` times."""
    own = np.concatenate([np.asarray(c.flatten(), np.int32) for c in part.column("tokens").chunks])
    tokens, counts = np.unique(own, return_counts=True)
    often = counts > FREQUENT
    return pa.table({"token": pa.array(tokens[often], pa.int32()), "m": pa.array(counts[often], pa.int64())})


def frequent(shorts: DataFrame, total: int) -> DataFrame:
    """(token, m): the short hashes that more than ``FREQUENT`` of the points (column hashes, ``total`` entries) hold, and how many do.

    They are counted in buckets of about a million, a few bytes each, since nearly all of them stand in one text only.
    """
    bits = min(24, max(10, (total >> 20).bit_length()))
    dealt = shorts.select("hashes").mapInArrow(_dealt(bits), "bucket int, tokens array<int>")
    return dealt.groupBy("bucket").applyInArrow(_often, "token int, m long")


def rarest_first(known: DataFrame, shorts_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """``known`` (columns rep, cls, n, first) with crowded and frequent shingles behind all others, by their number.

    Any order that all sets follow will do, so points without such shingles among their first keep them. What is frequent is counted
    over all shingles of the points that have a crowded one: behind the crowded ones of a group of copies come others that all of it holds.
    """
    crowded = staged(_met(known).filter(F.col("m") > CROWDED), "crowded")
    if not crowded.limit(1).count():
        return known
    firsts = known.select("rep", F.explode("first").alias("token"))
    touched = staged(firsts.join(crowded, "token", "left_semi").select("rep").distinct(), "crowded-points")
    total = known.join(touched, "rep", "left_semi").agg(F.sum("n")).first()[0]
    often = crowded.unionByName(frequent(shorts_of(touched), total)).groupBy("token").agg(F.max("m").alias("m"))
    often = staged(often, "frequent")
    late = firsts.join(often, "token", "left_semi").groupBy("rep").agg(F.count("*").alias("c"))
    lengths = known.select("rep", "n", F.size("first").alias("f"))
    # the rest holds such shingles in about the same share, so few points need all of theirs looked up
    part = F.ceil(F.col("f") * F.col("f") / F.greatest(F.col("f") - F.col("c"), F.lit(1)) * 1.25) + 16
    todo = staged(lengths.join(late, "rep").select("rep", "n", F.least("n", part).cast("int").alias("upto")), "points-to-order")

    def ordered(todo: DataFrame) -> DataFrame:
        shorts = shorts_of(todo).join(todo, "rep").select("rep", "n", F.slice("hashes", F.lit(1), F.col("upto")).alias("hashes"))
        last = shorts.select("rep", F.explode("hashes").alias("token")).join(often, "token")
        last = last.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("m", "token"))).alias("last"))
        placed = shorts.join(last, "rep").select("rep", "n", "hashes", F.col("last.token").alias("last"))
        return staged(placed.mapInArrow(_last(similarity), "rep long, moved array<int>"), "ordered")

    moved = ordered(todo)
    short = staged(todo.join(moved, "rep", "left_anti").withColumn("upto", F.col("n").cast("int")), "points-left")
    if short.limit(1).count():
        moved = moved.unionByName(ordered(short))
    return staged(known.join(moved, "rep", "left").select("rep", "cls", "n", F.coalesce("moved", "first").alias("first")), "reordered")


def first_candidates(known: DataFrame, shorts_of: Callable[[DataFrame], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of points (columns rep, cls, n, first) of different classes, among them all of the similarity.

    ``shorts_of`` gives the short hashes (rep, hashes) of the points it is handed. At the first shingle that two points share, both
    have as many left, that one included, as the threshold asks them to share. They also share as many of their first
    shingles as that overlap leaves when all later ones of the one are shared, one at least.
    """
    num, den = _parts(similarity)
    known = rarest_first(known, shorts_of, similarity)
    met = _met(known)
    entries = known.select("rep", "cls", "n", F.posexplode("first").alias("pos", "token")).withColumn("rest", F.col("n") - F.col("pos"))
    entries = staged(entries.drop("pos").join(met.select("token"), "token"), "first-entries")
    groups = entries.groupBy("token", "cls", "n").agg(F.max("rest").alias("rest"))

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("token", *[F.col(c).alias(f"{x}_{c}") for c in rows.columns if c != "token"])

    def enough(a: str, b: str):
        return F.least(a, b) * (num + den) >= (F.col("a_n") + F.col("b_n")) * num

    # classes and sizes first, the smaller set as a: the points of one class are never paired with each other, and of the
    # smaller one only shingles count that leave it enough for a set of its own size
    small = side(groups.filter(F.col("rest") * (num + den) >= F.col("n") * (2 * num)), "a")
    once = (F.col("a_n") < F.col("b_n")) | (F.col("a_n") == F.col("b_n")) & (F.col("a_cls") < F.col("b_cls"))
    pairs = small.join(side(groups, "b"), "token").filter((F.col("a_cls") != F.col("b_cls")) & once & enough("a_rest", "b_rest"))
    pairs = pairs.drop("a_rest").join(side(entries, "a"), ["token", "a_cls", "a_n"]).filter(enough("a_rest", "b_rest"))
    pairs = pairs.drop("b_rest").join(side(entries, "b"), ["token", "b_cls", "b_n"]).filter(enough("a_rest", "b_rest"))
    pairs = staged(pairs.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"), "a_n", "b_n").distinct(), "first-pairs")
    firsts = known.select("rep", "first")
    pairs = pairs.join(firsts.toDF("a", "a_first"), "a").join(firsts.toDF("b", "b_first"), "b")
    overlap = F.ceil((F.col("a_n") + F.col("b_n")) * num / (num + den) - F.lit(1e-6))
    later = F.floor((F.col("b_n") * num - 1) / den + F.lit(1e-6))
    shared = F.size("a_first") - F.size(F.array_except("a_first", "b_first"))
    return pairs.filter(shared >= overlap - later).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY,
                part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, text_hash, rep, root, component_id) of every row; component_id is the smallest id reachable over near copies."""
    rows = staged(sketches(docs, id_col, text_col, size, similarity), "sketches")
    points = staged(rows.groupBy("rep").agg(
        F.min("doc_id").alias("least"), F.min("text_hash").alias("text_hash"), F.first("fp").alias("fp"),
        F.first("bands").alias("bands"), F.first("low").alias("low"),
    ), "points")
    hashed = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))

    def rows_of(named: DataFrame, values: DataFrame) -> DataFrame:
        """The row of ``values``, which has one column beside text_hash, for each of the named points."""
        named = points.select("rep", "text_hash").join(named, "rep", "left_semi")
        return values.join(named, "text_hash").dropDuplicates(["rep"]).select("rep", *[c for c in values.columns if c != "text_hash"])

    def shorts_of(named: DataFrame) -> DataFrame:
        # half as long as the texts, so they are made before they are dealt out
        return rows_of(named, _sets(hashed, size, _short, "int").withColumnRenamed("rep", "text_hash"))

    def links_of(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs, "candidates")
        named = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        return staged(verified(pairs, staged(_sets(rows_of(named, hashed), size), "shingle-sets"), similarity), "links")

    pairs = band_candidates(points, similarity, part_rows).unionByName(print_candidates(points.select("rep", "fp"))).filter("a <> b")
    links = links_of(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    classes = staged(components(links), "classes-so-far")
    known = rows.groupBy("rep").agg(F.first("n").alias("n"), F.first("first").alias("first")).join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    known = staged(known.select("rep", F.coalesce("root", "rep").alias("cls"), "n", "first"), "first-of-points")
    further = links_of(first_candidates(known, shorts_of, similarity))
    if further.limit(1).count():
        classes = staged(components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(further)), "roots")
    roots = classes
    placed = points.select("rep", "least").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    placed = staged(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = staged(placed.select("rep", "root").join(ids, "root"), "classes")
    return rows.select("doc_id", "text_hash", "rep").join(classes, "rep")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY,
                     part_rows: int = PART_ROWS) -> DataFrame:
    """One row of each group of near copies, with all its columns: the one with the smallest id.

    Of several rows with that id, or where no row of a group has an id, one row stays.
    """
    placed = near_copies(docs, id_col, text_col, size, similarity, part_rows).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = placed.groupBy("root", "component_id").agg(F.min("text_hash").alias("text_hash"))
    keys = unused(docs, "_none", "_id", "_text")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    chosen = staged(chosen.select(
        F.col("component_id").isNull().alias(keys[0]), as_text("component_id").alias(keys[1]), F.col("text_hash").alias(keys[2]),
    ).distinct(), "kept-documents")
    keyed = docs.select(
        "*", F.col(id_col).isNull().alias(keys[0]), as_text(id_col).alias(keys[1]),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(keys[2]),
    )
    return keyed.join(chosen, keys, "left_semi").dropDuplicates(keys).drop(*keys)
