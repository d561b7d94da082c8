import random

import numpy as np
import pytest

from chronomesh.llm import near_copies
from tests.llm.conftest import SCHEMA, WORD, edge_rows, lower


def shingles(text, size=5):
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_groups(rows):
    """Component of each (doc_id, text) row, by comparing all distinct shingle sets that share a shingle."""
    rows = [(i, shingles(t)) for i, t in rows]
    sets = list({s for _, s in rows})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    met = {}
    for ids in holders.values():
        for k, i in enumerate(ids):
            for j in ids[:k]:
                met[i, j] = met.get((i, j), 0) + 1
    links = 0
    for (i, j), common in met.items():
        if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):  # similarity of 0.8 or more, in whole numbers
            root[find(i)] = find(j)
            links += 1
    at = {s: i for i, s in enumerate(sets)}
    return [(i, find(at[s])) for i, s in rows], links


def edited(draw, words, n):
    out = list(words)
    for p in draw.sample(range(len(out)), n):
        out[p] = f"edit{draw.randrange(10 ** 9)}"
    return out


def originals_and_copies(count=40, copies=8):
    """Texts of 150 words, each with copies that have one to three words changed, and clean texts that share a passage."""
    draw = random.Random(9)
    fresh = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    rows, passage = [], fresh(60)
    for _ in range(count):
        text = fresh(150)
        rows.append(" ".join(text))
        rows += [" ".join(edited(draw, text, draw.randrange(1, 4))) for _ in range(copies)]
        rows.append(" ".join(passage + fresh(60)))
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("part_rows", [2, 1024])
def test_groups_equal_all_pairs(spark, part_rows):
    rows = originals_and_copies()
    want, links = brute_groups(rows)
    assert links > 500
    least = {}
    for i, g in want:
        least[g] = min(i, least.get(g, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs, part_rows=part_rows).collect()}
    expected = {i: least[g] for i, g in want}
    together = sum(expected[i] == got[i] for i in got)
    assert got.keys() == expected.keys() and together >= 0.99 * len(rows)
    joined = {}
    for i, g in got.items():
        joined.setdefault(g, set()).add(expected[i])
    assert all(len(classes) == 1 for classes in joined.values())  # nothing is linked that all pairs do not link
    kept = [r.doc_id for r in near_copies.drop_near_copies(docs, part_rows=part_rows).collect()]
    assert sorted(kept) == sorted(set(got.values()))


def test_one_large_group_of_near_copies_is_one_group(spark):
    draw = random.Random(3)
    text = [f"w{draw.randrange(10 ** 6)}" for _ in range(200)]
    rows = [(i, " ".join(edited(draw, text, draw.randrange(0, 4)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = near_copies.drop_near_copies(docs, part_rows=100).collect()
    assert [r.doc_id for r in kept] == [0]


def test_tree_joins_what_the_threshold_joins():
    draw = np.random.default_rng(1)
    centres = draw.integers(0, 1000, (5, 96))
    low = np.repeat(centres, 6, axis=0).astype(np.uint16)
    low[draw.random(low.shape) < 0.15] = 7
    edges = near_copies.spanning_tree(low, 0.5)
    assert len(edges) == 25 and all(a // 6 == b // 6 for a, b in edges)


def test_estimate_is_near_the_similarity():
    draw = random.Random(4)
    words = [b"w%d" % draw.randrange(10 ** 6) for _ in range(400)]
    other = words[:340] + [b"v%d" % i for i in range(60)]
    a, b = near_copies.shingle_hashes(words), near_copies.shingle_hashes(other)
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_copies.minima(a) == near_copies.minima(b)).mean() - exact) < 0.15


def test_edge_rows_equal_all_pairs(spark, edge):
    rows = [(r[0], r[1]) for r in edge_rows()]
    want, _ = brute_groups(rows)
    groups = {}
    for i, g in want:
        groups.setdefault(g, []).append(i)
    kept = near_copies.drop_near_copies(edge)
    assert kept.columns == edge.columns
    least = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got, key=str) == sorted(least, key=str)


def test_empty_table(spark, empty):
    kept = near_copies.drop_near_copies(empty)
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")] and kept.count() == 0


def cut_pairs(count=400):
    """Texts of 150 words, each with a copy whose last 16 are others: 130 of 162 shingles are shared, close to the threshold."""
    draw = random.Random(21)
    rows = []
    for _ in range(count):
        text = [f"w{draw.randrange(10 ** 6)}" for _ in range(150)]
        rows += [" ".join(text), " ".join(text[:-16] + [f"x{draw.randrange(10 ** 6)}" for _ in range(16)])]
    return list(enumerate(rows))


def classes_of(docs):
    return {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}


def expected_classes(rows):
    want, links = brute_groups(rows)
    least = {}
    for i, g in want:
        least[g] = min(i, least.get(g, i))
    return {i: least[g] for i, g in want}, links


def test_no_pair_near_the_threshold_is_left_out(spark):
    rows = cut_pairs()
    want, links = expected_classes(rows)
    assert links == 400
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_pairs_at_the_threshold_with_crowded_shingles(spark, monkeypatch):
    """One passage in all texts; beside it 20 families at a similarity of 0.8 exactly and just below it."""
    monkeypatch.setattr(near_copies, "CROWDED", 3)
    draw = random.Random(5)
    fresh = lambda n: [f"w{draw.randrange(10 ** 6)}" for _ in range(n)]
    passage, rows = fresh(100), []
    for _ in range(20):
        text = passage + fresh(12)  # 108 shingles
        rows += [text, text[:-12] + fresh(12), text[:-13] + fresh(13), text + fresh(27), text + fresh(28)]
    rows = [(i, " ".join(words)) for i, words in enumerate(rows)]
    want, links = expected_classes(rows)
    assert links > 20 and len(set(want.values())) > 1
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want


def test_first_shingles_hold_one_of_every_similar_set():
    draw = np.random.default_rng(2)
    for n in range(1, 60):
        full = draw.choice(1000, n, replace=False)
        for m in range(1, n + 1):
            if 5 * m >= 4 * n:  # a subset of the similarity
                part = np.sort(draw.choice(full, m, replace=False))
                assert set(np.sort(full)[:near_copies.first_length(n)]) & set(part[:near_copies.first_length(m)])


def test_points_join_only_across_classes(spark, monkeypatch):
    """Crowded shingles go last; pairs of one class are not named again."""
    monkeypatch.setattr(near_copies, "CROWDED", 2)
    sets = {1: [1, 2, 3, 10, 11], 2: [1, 2, 3, 10, 11], 3: [1, 2, 3, 10, 12], 4: [1, 2, 3, 13, 14]}
    table = spark.createDataFrame(list(sets.items()), "rep long, hashes array<int>")
    known = spark.createDataFrame([(r, 1 if r < 3 else r, 5, s[:2]) for r, s in sets.items()], "rep long, cls long, n long, first array<int>")
    got = near_copies.first_candidates(known, lambda named: table.join(named, "rep", "left_semi"))
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 3)]


def test_group_of_looser_copies_names_few_pairs(spark, monkeypatch):
    """Copies of one text with so many words changed that most pairs lie below the threshold: they share shingles, not links."""
    draw = random.Random(11)
    text = [f"w{draw.randrange(10 ** 6)}" for _ in range(150)]
    rows = [(i, " ".join(edited(draw, text, draw.randrange(2, 20)))) for i in range(700)]
    want, links = expected_classes(rows)
    assert links > 100 and len(set(want.values())) > 300
    named, verified = [], near_copies.verified

    def counted(candidates, *args):
        named.append(candidates.count())
        return verified(candidates, *args)

    monkeypatch.setattr(near_copies, "verified", counted)
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == want
    assert named[1] < 3 * len(rows)  # by first shingles; not their square
