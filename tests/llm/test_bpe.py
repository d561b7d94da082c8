import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from chronomesh.llm import bpe
from tests.llm.conftest import edge_rows

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return bpe.parse_ranks(file.read())


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(ranks, reference):
    draw = random.Random(2)
    texts = ["", "a" * 3000, "".join(draw.choice("abcdeté") for _ in range(9000)), " \n\n x  ", "<|endoftext|>"]
    texts += ["".join(draw.choice("aab ñ漢1!'s\n\t😀") for _ in range(draw.randint(1, 200))) for _ in range(500)]
    codec = bpe.Codec(ranks, PATTERN)
    assert codec.encode_all(texts) == [reference.encode_ordinary(t) for t in texts]


def test_short_and_long_merges_agree(ranks):
    draw = random.Random(3)
    codec = bpe.Codec(ranks, PATTERN)
    pieces = ["".join(draw.choice("aabcté'") for _ in range(draw.randint(1, 60))).encode() for _ in range(300)]
    assert codec.merge(pieces) == [codec.merge_long(p) for p in pieces]


def test_ranks_that_fall_after_a_merge():
    """A vocabulary in which a merge makes a pair of a lower rank: the leftmost pair of the lowest rank still goes first."""
    ranks = {bytes([b]): 100 + b for b in range(256)} | {b"ab": 50, b"aba": 10, b"abab": 60}
    codec = bpe.Codec(ranks, r".+")
    for text in (b"abab", b"ababab", b"aababba", b"abaabab"):
        assert codec.merge([text])[0] == codec.merge_long(text) == greedy(ranks, text)


def greedy(ranks, data):
    parts = [data[i:i + 1] for i in range(len(data))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return tuple(ranks[p] for p in parts)
        parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_queue_order():
    queue = bpe.RankQueue(50_000)
    draw = random.Random(4)
    entries = [(draw.randrange(50_000), draw.randrange(1000)) for _ in range(2000)]
    for rank, at in entries:
        queue.push(rank, at)
    assert [queue.pop() for _ in entries] == sorted(entries) and not queue.top


def test_cache_may_be_forgotten(ranks, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    codec = bpe.Codec(ranks, PATTERN)
    for _ in range(3):
        assert codec.encode_all(["some words nobody knows", "xyzzy plugh"]) == [
            reference.encode_ordinary(t) for t in ("some words nobody knows", "xyzzy plugh")]


def test_digests_and_round_trip(spark, edge, reference, empty):
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for r in edge_rows():
        ids = reference.encode_ordinary(r[1] or "")
        want.append(repr((r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha((r[1] or "").encode()))))
    assert sorted(repr(tuple(r)) for r in bpe.round_trip(edge, PATH, PATTERN).collect()) == sorted(want)
    checked = bpe.encode_checked(edge, PATH, PATTERN)
    assert checked.filter("exact").count() == len(want)
    encoded = bpe.encode(edge, PATH, PATTERN)
    back = bpe.decode(encoded, PATH, PATTERN)
    assert back.columns == [*edge.columns, "token_ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert bpe.round_trip(empty, PATH, PATTERN).collect() == []


def test_bytes_only_vocabulary_and_clashing_names(spark, tmp_path):
    import base64

    path = tmp_path / "bytes.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(bytes([b])) + f" {b}\n".encode() for b in range(256)))
    df = spark.createDataFrame([(1, "héllo " + "x" * 500, "mine", "yours")], "doc_id int, text string, token_ids string, decoded string")
    ids = bpe.encode(df, str(path), public_tokenizers.PATTERN)
    back = bpe.decode(ids, str(path), public_tokenizers.PATTERN, "token_ids_")
    row = back.first()
    assert (row.token_ids, row.decoded) == ("mine", "yours") and list(row.token_ids_) == list(row.text.encode())
    assert bytes(row.decoded_) == row.text.encode() and len(set(back.columns)) == len(back.columns)


def test_unknown_pre_tokens_are_merged_in_small_lots(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"abc": 257, b"bc": 258, b"cab": 259}
    lots = []

    class Watched(bpe.Codec):
        def merge(self, pieces):
            lots.append(sum(map(len, pieces)))
            return super().merge(pieces)

    monkeypatch.setattr(bpe, "MERGE_BYTES", 200, raising=False)
    codec = Watched(ranks, r"\S+|\s+")
    draw = random.Random(1)
    words = ["".join(draw.choice("abcx") for _ in range(draw.randrange(5, 40))) for _ in range(500)]
    got = codec.encode_all([" ".join(words)])[0]
    want = [i for k, w in enumerate(words) for i in ([*([32] if k else []), *codec.merge_long(w.encode())])]
    assert got == want and max(lots) <= 200 and len(lots) > 10
