"""Merkle manifest of a table: every row gets its digest, the root, and the siblings that lead from one to the other.

A node's digest is the lower-case hex SHA-256 of its inputs one after the other, digests as hex text. A leaf's inputs
are the row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. Leaves of one group, ordered by
id, are paired level by level; the last of an odd number of nodes is hashed alone. What is left is the group's subroot;
the subroots, ordered by group (null first, bytes ascending), are paired likewise up to the root.

All nodes of a level sit on the rows of their first leaves. At level j these are the rows whose place is a multiple of
2 ** j, so the sibling of a node is the row 2 ** j places after or before it: a ``lead`` or ``lag`` of fixed offset,
masked by the node's slot (bit j of the place) and by the length of the run (a node that is alone has none). Downwards
the way works likewise: a node in slot 1 takes its parent's path from the row 2 ** j before.

Windows run over blocks of ``2 ** LEVELS`` neighbouring places of one group, so a task never holds a run and a group
with most rows is many blocks. The roots of the blocks are the nodes of the next tier, 64 times fewer, until one is left.
The places come from a range partitioning by (group, id), which splits a hot group; equal ids are ordered by digest,
equal rows by their place in the file.

Defined results: a null id comes first; repeated ids and rows are leaves each; an empty table has no rows and no root; a
null group is a group; a lone leaf is its group's subroot, a lone subroot the root, and the proof of a tree of one leaf
is the digest of nothing. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.store import staged
from chronomesh.operators.scaling import dense_index

#: Levels a block of places spans.
LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field as a leaf's input: ``-`` or the byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(values: list[Column]) -> Column:
    return digest(*[field(v) for v in values])


def _first(level: int) -> Column:
    """The row is the first of a node of this level."""
    return F.col("place").bitwiseAND(F.lit((1 << level) - 1)) == 0


def _left(level: int) -> Column:
    return F.col("place").bitwiseAND(F.lit(1 << level)) == 0


def _block_window() -> Window:
    return Window.partitionBy("run", "block").orderBy("place")


def _tier(nodes: DataFrame, levels: int) -> DataFrame:
    """Hash the nodes (run, place, n, node) upwards inside blocks.

    ``s0`` .. hold the sibling of the node of that level that begins on the row (null: none), ``top`` the block's root
    on its first row.
    """
    out = nodes.withColumn("block", F.shiftright("place", levels)).withColumn("top", F.col("node"))
    for level in range(levels):
        step, over = 1 << level, _block_window()
        paired = _first(level) & (F.col("n") > step)  # as long as the run has several nodes
        out = out.withColumn("_after", F.lead("top", step).over(over)).withColumn("_before", F.lag("top", step).over(over))
        out = out.withColumn(f"s{level}", F.when(paired, F.when(_left(level), F.col("_after")).otherwise(F.col("_before"))))
        parent = F.when(F.col("n") > step, digest(F.col("top"), F.coalesce(f"s{level}", F.lit("")))).otherwise(F.col("top"))
        out = out.withColumn("top", F.when(_first(level + 1), parent)).drop("_after", "_before")
    return out


def _climb(nodes: DataFrame, longest: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """All tiers, and (run, node) with the root of every run; ``longest`` is the length of the longest run."""
    tiers = []
    while longest > 1:
        tiers.append(staged(_tier(nodes, levels), "merkle-tier"))
        nodes = tiers[-1].filter(_first(levels)).select(
            "run", F.col("block").alias("place"), F.shiftright(F.col("n") + (1 << levels) - 1, levels).alias("n"), F.col("top").alias("node"))
        longest = (longest + (1 << levels) - 1) >> levels
    return tiers, nodes.select("run", "node")


def _descend(tiers: list[DataFrame], roots: DataFrame, levels: int) -> DataFrame:
    """The last tier's rows with ``path``, the siblings up to the root, and the further columns of ``roots`` (run, path, ..).

    A step of the path is (left, sibling): whether the node is the left one, and its sibling's digest, null if it has none.
    """
    carried = [c for c in roots.columns if c not in ("run", "path")]
    above = roots.withColumn("place", F.lit(0).cast("long"))
    for tier in reversed(tiers):
        out = tier.withColumn("path", F.array().cast("array<struct<left:boolean,sibling:string>>"))
        for level in reversed(range(levels)):
            step, over = 1 << level, _block_window()
            parent = F.when(_left(level), F.col("path")).otherwise(F.col("_before"))
            here = F.array(F.struct(_left(level).alias("left"), F.col(f"s{level}").alias("sibling")))
            out = out.withColumn("_before", F.lag("path", step).over(over)).withColumn(
                "path", F.when(_first(level), F.when(F.col("n") > step, F.concat(here, parent)).otherwise(parent))).drop("_before")
        upper = above.select("run", F.col("place").alias("block"), F.col("path").alias("_upper"), *carried)
        above = out.join(upper, ["run", "block"]).withColumn("path", F.concat("path", "_upper")).drop("_upper")
    return above


def _empty_path() -> Column:
    return F.array().cast("array<struct<left:boolean,sibling:string>>")


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, path) and the further columns of ``leaves``, a table of (id, grp, leaf, ..).

    ``path`` lists (left, sibling) level by level from the leaf to the root.
    """
    leaves = staged(leaves, "merkle-leaves").withColumn("_row", F.monotonically_increasing_id())
    placed = dense_index(leaves, ["grp", "id", "leaf", "_row"], "_at").drop("_row")
    groups = placed.groupBy("grp").agg(F.min("_at").alias("_start"), F.count("*").alias("n"))
    groups = staged(dense_index(groups, ["grp"], "run"), "merkle-groups")
    size = groups.agg(F.count("*").alias("groups"), F.max("n").alias("longest")).first()
    known = groups.select(F.col("grp").alias("_grp"), "_start", "n", "run")
    nodes = placed.join(known, F.col("grp").eqNullSafe(F.col("_grp"))).withColumns(
        {"place": F.col("_at") - F.col("_start"), "node": F.col("leaf")}).drop("_grp", "_at", "_start")
    tiers, subroots = _climb(nodes, size["longest"] or 0, levels)
    subroots = staged(subroots, "merkle-subroots")
    upper = subroots.select(F.lit(0).alias("run"), F.col("run").alias("place"), F.lit(size["groups"]).cast("long").alias("n"), "node")
    upper_tiers, roots = _climb(upper, size["groups"], levels)
    root = roots.first()
    root = F.lit(root["node"] if root else None).cast("string")
    if upper_tiers:
        ways = _descend(upper_tiers, roots.select("run", _empty_path().alias("path")), levels)
        ways = ways.select(F.col("place").alias("run"), F.col("node").alias("subroot"), "path")
    else:
        ways = subroots.select("run", F.col("node").alias("subroot"), _empty_path().alias("path"))
    rows = _descend(tiers, ways, levels) if tiers else nodes.join(ways, "run")
    further = [c for c in leaves.columns if c not in ("id", "grp", "leaf", "_row")]
    return rows.select("id", "leaf", "subroot", root.alias("root"), "path", *further)


def proof(path: Column) -> Column:
    """The siblings of a path, in order."""
    return F.array_join(F.transform(path, lambda step: step["sibling"]), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def up(node: Column, step: Column) -> Column:
        other = F.coalesce(step["sibling"], F.lit(""))
        return F.when(step["left"], digest(node, other)).otherwise(digest(other, node))

    return F.aggregate(path, leaf, up)


def document_manifest(docs: DataFrame, tamper_every: int = 7) -> DataFrame:
    """The manifest of ``documents`` by language, verified after tampering.

    Where ``tamper_every`` divides the CRC of the id, one is added to ``n_chars`` before the leaf is made again; the root
    is folded from that leaf and the untampered siblings.
    """
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0, F.lit(False))
    values = {name: F.col(name) for name in FIELDS}
    changed = leaf_of([*(values | {"n_chars": F.col("n_chars") + 1}).values()])
    leaves = docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("grp"), leaf_of([*values.values()]).alias("leaf"),
        F.when(tampered, changed).alias("changed"),
    )
    rows = manifest(leaves).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return rows.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
