import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from chronomesh.llm import simhash
from chronomesh.llm.components import components
from tests.llm.conftest import WORD, edge_rows, lower


def brute_print(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(points, radius=3):
    root = {p: p for p in points}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(root), 2):
        if (a ^ b).bit_count() <= radius:
            root[find(a)] = find(b)
    return {p: find(p) for p in root}


def partition(of):
    groups = {}
    for x, r in of.items():
        groups.setdefault(r, set()).add(x)
    return sorted(map(sorted, groups.values()))


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks(3)
    assert len(masks) == 15
    for flipped in combinations(range(64), 3):
        difference = sum(1 << i for i in flipped)
        assert any(not difference & m for m in masks)


def test_reports_equal_brute_force(spark, edge):
    rows = edge_rows()
    prints = [brute_print(r[1]) for r in rows]
    of = classes(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r[0] is not None:
            least[of[p]] = min(least.get(of[p], r[0]), r[0])
    got = sorted(map(repr, (tuple(r) for r in simhash.near_duplicates(edge).collect())))
    assert got == sorted(repr((r[0], f"{p:016x}", least.get(of[p]))) for r, p in zip(rows, prints))


@pytest.mark.parametrize("bucket_rows", [4096, 2, 1])
def test_links_join_dense_clusters_whatever_the_bucket_size(spark, bucket_rows):
    draw = random.Random(bucket_rows)
    points = {draw.getrandbits(64) for _ in range(200)}
    for centre in list(points)[:4]:
        for _ in range(60):
            points.add(centre ^ sum(1 << i for i in draw.sample(range(64), draw.randint(1, 3))))
    df = spark.createDataFrame([(simhash.signed(p),) for p in points], "fp long")
    roots = {r.node % 2**64: r.root for r in components(simhash.near_links(df, 3, bucket_rows)).collect()}
    got = {p: roots.get(p, simhash.signed(p)) for p in points}
    assert partition(got) == partition(classes(points))


def test_spanning_links_are_within_the_radius():
    points = np.array([0, 1, 3, 7, 15, 255, 2**63], np.uint64).view(np.int64)
    links = simhash.spanning_links(points, 1)
    assert len(links) == 5 and all(((a ^ b) & (2**64 - 1)).bit_count() <= 1 for a, b in links)


def test_chain_of_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_one_document_of_each_group_stays(spark, edge):
    kept = simhash.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    report = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(edge).collect()}
    got = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    # the repeated id 3 stands for two components
    assert sorted(got) == sorted([d for d, c in report if d is not None and d == c] + [3])


def test_empty_table(spark, empty):
    assert simhash.near_duplicates(empty).collect() == [] and simhash.drop_near_duplicates(empty).collect() == []
