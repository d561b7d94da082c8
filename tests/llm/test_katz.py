import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronomesh.llm import katz, queries_katz
from tests.llm.conftest import SCHEMA, WORD, edge_rows, lower


def tokens(text):
    return [*WORD.findall(lower(text)), "</s>"]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def brute(rows):
    words, pairs = Counter(), Counter()
    for d, text in rows:
        if not held(d):
            words.update(x := tokens(text))
            pairs.update(zip(["<s>", *x], x))
    n, v = sum(words.values()), len(words)
    met = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(met(words)), katz.discounts(met(pairs))
    cut = lambda c, d: c * (d[c - 1] if c <= len(d) else 1)
    kept = sum(cut(c, d1) for c in words.values())
    divisor = n if n - kept > 1e-9 * n else n + 1
    p, unknown = {w: cut(c, d1) / divisor for w, c in words.items()}, 1 - kept / divisor
    follow, alpha, seen = defaultdict(dict), {}, {}
    for (h, w), c in pairs.items():
        if c >= 2:
            follow[h][w] = c
    for h, f in follow.items():
        total, mass = words["</s>"] if h == "<s>" else words[h], sum(cut(c, d2) for c in f.values())
        total += not total - mass > 1e-9 * total
        alpha[h] = (1 - mass / total) / (1 - sum(p[w] for w in f))
        seen.update({(h, w): cut(c, d2) / total for w, c in f.items()})
        # exactly normalised: followers, all other words, and the unknown class
        assert math.isclose(sum(seen[h, w] for w in f) + alpha[h] * (sum(q for w, q in p.items() if w not in f) + unknown), 1)
    out = []
    for d, text in rows:
        x, h, score = tokens(text), "<s>", 0.0
        for w in x:
            score += math.log10(seen[h, w] if (h, w) in seen else alpha.get(h, 1) * p.get(w, unknown))
            h = w
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in x)
        out.append((d, held(d), len(x), sum(w in words for w in x), n, round(base, 6), round(score, 6)))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))) for r in df.collect())


@pytest.mark.parametrize("sizes", [{}, {"head_words": 8, "head_bigrams": 4, "bloom_bits": 1 << 12}, {"head_words": 0, "head_bigrams": 0, "bloom_bits": 64}])
def test_scores_equal_brute_force(spark, edge, sizes):
    assert found(katz.fit_and_score(edge, **sizes)) == brute([r[:2] for r in edge_rows()])


def test_real_prose_equals_brute_force(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").select("doc_id", "text")
    assert found(katz.fit_and_score(docs, head_words=200, head_bigrams=200)) == brute([tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("head_words", [8, 1000])
def test_frequent_histories_over_many_buckets(spark, edge, monkeypatch, head_words):
    monkeypatch.setattr(katz, "HOT", 1)  # every history met twice is dealt out, unnumbered ones too
    monkeypatch.setattr(katz, "GATHER", 64)  # on the driver: many buckets
    assert found(katz.fit_and_score(edge, head_words=head_words, head_bigrams=4)) == brute([r[:2] for r in edge_rows()])


def test_packing():
    for values in ([], [0], [1, 2, 1 << 63], list(range(1000))):
        x = np.array(values, np.uint64)
        assert katz.unpack(katz.pack(x)).tolist() == values
        assert np.cumsum(katz.unpack(katz.pack(katz._steps(x)))).tolist() == values
    assert katz.unpack(katz.pack(np.array([-1.5, 0.0])), np.float64).tolist() == [-1.5, 0.0]


def test_without_training_rows(spark, empty):
    assert katz.fit_and_score(empty).collect() == []
    only = next(i for i in range(100) if held(i))
    row = katz.fit_and_score(spark.createDataFrame([(only, "a b", "", "", 1, 1, "", 1)], SCHEMA)).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_discounts():
    assert katz.discounts([0, 0, 0]) == [1.0, 1.0]
    d = katz.discounts([100, 40, 20, 12, 8, 5])
    assert len(d) == 5 and all(0 < x <= 1 for x in d)


def test_query_scores_bigrams_met_once(spark, tiny):
    docs = [(r.doc_id, tokens(r.text)) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    words, pairs = Counter(), Counter()
    for d, x in docs:
        if not held(d):
            words.update(x)
            pairs.update(zip(["<s>", *x], x))
    met = lambda c: [sum(x == r for x in c.values()) for r in range(1, 7)]
    d1, d2 = katz.discounts(met(words)), katz.discounts(met(pairs))
    cut = lambda c, d: c * (d[c - 1] if c <= len(d) else 1)
    n, kept = sum(words.values()), sum(cut(c, d1) for c in words.values())
    divisor = n if n - kept > 1e-9 * n else n + 1
    p, mass, lower = {w: cut(c, d1) / divisor for w, c in words.items()}, Counter(), Counter()
    for (h, w), c in pairs.items():
        mass[h] += cut(c, d2)
        lower[h] += p[w]
    total = {h: words["</s>" if h == "<s>" else h] for h in mass}
    total = {h: t if t - mass[h] > 1e-9 * t else t + 1 for h, t in total.items()}
    got = {r.doc_id: r.score for r in queries_katz.op3_katz_backoff(spark, tiny).collect()}
    for d, x in docs:
        score = 0.0
        for h, w in zip(["<s>", *x], x):
            alpha = (1 - mass[h] / total[h]) / (1 - lower[h]) if h in total else 1.0
            score += math.log10(cut(pairs[h, w], d2) / total[h] if (h, w) in pairs else alpha * p.get(w, 1 - kept / divisor))
        assert math.isclose(got[d], score, rel_tol=1e-6, abs_tol=1e-6), d
