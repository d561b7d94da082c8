import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chronomesh.llm import merkle
from tests.llm.conftest import SCHEMA, edge_rows


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row[:5]
    values = [doc_id, source, lang, n_chars, text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root, and for every node the siblings level by level as (left, sibling)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            paths[i].append((place % 2 == 0, nodes[other] if other < len(nodes) else None))
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        at = [place // 2 for place in at]
    return nodes[0], paths


def up(node, path):
    for left, sibling in path:
        node = sha(node, sibling or "") if left else sha(sibling, node)
    return node


def brute(rows):
    runs = {}
    for row in rows:
        runs.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    order = sorted(runs, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: tree([x[2] for x in sorted(runs[lang], key=lambda x: x[:3])]) for lang in order}
    root, ways = tree([trees[lang][0] for lang in order])
    out = []
    for lang, way in zip(order, ways):
        for (*_, node, row), path in zip(sorted(runs[lang], key=lambda x: x[:3]), trees[lang][1]):
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[4] is not None:
                changed = (*row[:4], row[4] + 1)
            fold = up(leaf(changed), path + way)
            out.append((row[0], node, trees[lang][0], root, sha(*[s or "" for _, s in path + way]), fold, fold == root))
    return sorted(out, key=str)


def check(df, rows):
    got = sorted(map(tuple, merkle.document_manifest(df).collect()), key=str)
    assert got == brute(rows)
    return got


def test_edge_rows(spark, edge):
    got = check(edge, edge_rows())
    assert {row[-1] for row in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 129])
def test_lengths_around_a_block(spark, n):
    rows = [(i, f"text {i}", "en", "s", i) for i in range(n)]
    check(spark.createDataFrame([(*r, 0, "w", 0) for r in rows], SCHEMA), rows)


def test_hot_group_many_groups_and_repeated_rows(spark):
    rows = [(i, "x" * (i % 5), "hot" if i % 3 else f"l{i:05d}", None, i) for i in range(900)] + [(7, "same", None, "s", None)] * 40
    df = spark.createDataFrame([(*r, 0, "w", 0) for r in rows], SCHEMA).repartition(5)
    check(df, rows)


@pytest.mark.parametrize("levels", [1, 3, 7])
def test_block_size_changes_nothing(spark, levels):
    nodes = [(i, f"g{i % 2}", sha(str(i))) for i in range(150)]
    df = spark.createDataFrame(nodes, "id long, grp string, leaf string").repartition(4)
    rows = merkle.manifest(df, levels)
    assert rows.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 150
    assert len({r.root for r in rows.collect()}) == 1
    got = {r.id: (r.root, r.subroot) for r in rows.collect()}
    subroots = [tree([x[2] for x in nodes if x[1] == g])[0] for g in ("g0", "g1")]
    assert got == {i: (tree(subroots)[0], subroots[i % 2]) for i in range(150)}


def test_empty_table_and_very_long_text(spark, empty):
    assert merkle.document_manifest(empty).collect() == []
    row = (5, "é" * 2_000_000, "fr", "s", 2_000_000)
    check(spark.createDataFrame([(*row, 0, "w", 0)], SCHEMA), [row])


def test_windows_never_hold_a_run(spark, edge):
    plan = merkle.document_manifest(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan
