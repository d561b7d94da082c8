import random

import numpy as np
import pytest

from chronomesh.llm import decontaminate
from tests.llm.conftest import SCHEMA, edge_rows

DRAW = random.Random(11)
VOCABULARY = ["".join(DRAW.choice("abcdefgh") for _ in range(5)) for _ in range(400)]


def prose(n):
    return [DRAW.choice(VOCABULARY) for _ in range(n)]


def brute_score(item, words):
    rows, cols = len(item) + 1, len(words) + 1
    h = np.zeros((rows, cols), int)
    for i in range(1, rows):
        for j in range(1, cols):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if item[i - 1] == words[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_equals_the_full_matrix():
    for _ in range(40):
        a, b = ([DRAW.randrange(6) for _ in range(DRAW.randint(1, 25))] for _ in range(2))
        assert decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute_score(a, b)


@pytest.fixture(scope="module")
def corpus():
    items = [prose(40) for _ in range(6)] + [prose(2)]
    docs, planted = [], set()
    for i in range(60):
        words = prose(150)
        if i % 3 == 0:
            k = i // 3 % 7
            copy = list(items[k])
            if i % 2 and len(copy) > 10:  # edited: replace, drop and insert words
                for at in (5, 14, 23, 32):
                    copy[at] = "edited"
                del copy[28]
                copy.insert(18, "more")
            words = words[:70] + copy + words[70:]
            planted.add((i, k))
        docs.append((i, " ".join(words).title().replace(" ", ", ", 3)))
    return [(k, " ".join(x)) for k, x in enumerate(items)], docs, planted


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_exact_and_edited_copies_are_found(spark, corpus, block_bytes):
    items, docs, planted = corpus
    found = decontaminate.find_leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string"), block_bytes=block_bytes,
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} == planted
    # seeds and regions lose nothing: each score is that of a full alignment
    for r in found:
        item, words = items[r.item_id][1].split(), docs[r.doc_id][1].lower().replace(",", "").split()
        assert r.score == brute_score(item, words)
        assert words[r.start_word] == item[0] and words[r.end_word - 1] == item[-1]


def test_filter_drops_leaking_rows_only(spark, corpus):
    items, docs, planted = corpus
    table = spark.createDataFrame([(d, t, None, None, None, None, None, None) for d, t in docs] + edge_rows(), SCHEMA)
    kept = decontaminate.drop_leaks(table, spark.createDataFrame(items, "item_id int, text string"))
    assert kept.columns == table.columns
    assert kept.count() == table.count() - len(planted)


def test_defined_results(spark, edge, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "no id here"), (3, "no id here"), (None, "another text for a known id")], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(edge, items).collect()}
    assert got == {(None, 3), (3, None)}
    assert decontaminate.find_leaks(empty, items).collect() == []
    assert decontaminate.find_leaks(edge, items.limit(0)).collect() == []
    assert decontaminate.drop_leaks(edge, items.limit(0)).count() == edge.count()


@pytest.mark.parametrize("size", [15, 20, 40])
def test_copies_with_an_edit_in_every_fifth_word_are_found(spark, size):
    items = [prose(size) for _ in range(8)]
    docs = []
    for i, item in enumerate(items):
        copy = [f"edit{at}" if at % 5 == 4 else word for at, word in enumerate(item)]
        docs.append((i, " ".join(prose(60) + copy + prose(60))))
    args = [spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id int, text string")]
    found = decontaminate.find_leaks(*args).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, i) for i in range(8)}
    for r in found:
        assert r.score == brute_score(items[r.item_id], docs[r.doc_id][1].split())
    assert decontaminate.drop_leaks(*args).count() == 0


def test_regions_do_not_depend_on_how_many_hits_are_laid_out(monkeypatch):
    item = " ".join(prose(20)).encode()
    texts = [b"", item, b" ".join([item] * 3), " ".join(prose(50)).encode(), item + b" " + item]
    seeds = decontaminate.Seeds([item, item, b"x " + item], 3)
    whole = decontaminate.leaks(texts, seeds, 0.5)
    monkeypatch.setattr(decontaminate, "_ENTRIES", 1)
    assert decontaminate.leaks(texts, seeds, 0.5) == whole and {d for d, *_ in whole} == {1, 2, 4}


def test_an_item_with_two_texts_gives_one_row_a_document(spark):
    words = [f"word{i}" for i in range(24)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(words[:12])), (7, " ".join(words[4:24])), (7, None), (8, " ".join(words[3:15]))], "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 1):
        got = sorted((r.doc_id, r.item_id, r.start_word, r.end_word) for r in decontaminate.find_leaks(docs, items, block_bytes=size).collect())
        assert got == [(1, 7, 4, 24), (1, 8, 3, 15)]
