from collections import Counter

from chronomesh.llm import quality
from tests.llm.conftest import WORD, edge_rows


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)), len(lines)


def verdict(text):
    (n, chars, symbols, dups, repeat), lines = brute(text)
    failed = n < 20 or 100 * repeat > 30 * n
    return failed, not (failed or 10 * symbols > n or chars < 2 * n or chars > 15 * n or 2 * dups > lines)


def test_report_equals_brute_force(spark, edge):
    got = sorted(map(repr, (tuple(r) for r in quality.quality_report(edge).collect())))
    assert got == sorted(repr((r[0], *brute(r[1])[0], *verdict(r[1]))) for r in edge_rows())


def test_filter_keeps_columns_and_rows(spark, edge):
    kept = quality.quality_filter(edge)
    assert kept.columns == edge.columns
    assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in edge.collect() if verdict(r.text)[1])


def test_order_changes_cost_not_result(spark):
    rows = [r[1].encode() if r[1] else b"" for r in edge_rows()]
    want = None
    for rules in (quality.RULES, quality.RULES[::-1]):
        got = quality._verdicts(rows, list(rules))["kept"].tolist()
        want = want or got
        assert got == want


def test_rules_are_ordered_by_rejection_per_cost():
    rates = [("slow", 1.0, 0.5), ("fast", 0.01, 0.1), ("never", 0.001, 0.0), ("tie_b", 0.02, 0.2), ("tie_a", 0.02, 0.2)]
    assert quality.order_rules(rates) == ["fast", "tie_a", "tie_b", "slow", "never"]


def test_later_rules_see_survivors_only():
    seen = []
    first = quality.Rule("first", lambda b: b["n_words"] < 3)
    second = quality.Rule("second", lambda b: seen.append(len(b.texts)) or b["n_words"] > 4)
    mask = quality.run_cascade(quality.Block([b"a", b"a b c", b"a b c d e", b"a b"]), [first, second])
    assert mask.tolist() == [False, True] and seen == [2]


def test_empty_table(spark, empty):
    assert quality.quality_report(empty).collect() == [] and quality.quality_filter(empty).collect() == []
