import hashlib
import re

from chronomesh.llm import secrets
from tests.llm.conftest import SCHEMA, edge_rows

letters = lambda s: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s)
BASE = {
    "assign": (re.compile(
        f"({letters('password')}|{letters('passwd')}|{letters('secret')}|{letters('token')}|{letters('api')}_?{letters('key')})"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
GITHUB = "gh" + "p_" + "a1B2c3D4" * 5


def base_spans(text):
    return sorted((m.start(), rank, m.end(), kind) for rank, (kind, (pattern, ok)) in enumerate(BASE.items())
                  for m in pattern.finditer(text or "") if ok(m))


def rows():
    plain = [
        (20, "x token=abc secret=token=abcdef AKIA" + "Q" * 16 + f" {GITHUB} é password: 'éabcdef' API_KEY:abcdefg.", "en", "s1"),
        (21, "Token = '" + "0123456789abcdef" * 2 + "' and AKIA" + "Z9" * 30, "en", "s2"), (22, "ſecret=abcdefgh toKen=abcdefgh", None, None),
        (23, f"only here {GITHUB[:-1]}Z", "en", "s2"), (24, "AKIASHORT AKIA" + "B" * 15 + " deadbeef" * 3 + "deadbeefdeadbeefdeadbeef", "fr", "s3"),
    ] + [(30 + i, f"copied example {'gh' + 'p_' + 'k9' * 20} again", "en", f"s{i}") for i in range(4)]
    return [(*r, 1, None, None, None) for r in plain] + edge_rows()


def test_base_spans_equal_brute_force(spark):
    got = secrets.secret_report(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()
    want = []
    for d, text, *_ in rows():
        spans = base_spans(text)
        counts = [sum(s[3] == k for s in spans) for k in BASE]
        want.append(repr((d, *counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest())))
    assert sorted(repr((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256)) for r in got) == sorted(want)
    by_id = {r.doc_id: r for r in got}
    assert "github:10:54" in by_id[23].spans and by_id[23].n_live == 1
    assert all(by_id[30 + i].spans == "" for i in range(4))  # an added kind that four owners share is an example
    assert by_id[20].spans.split(",")[0] == "assign:12:31"


def test_masking(spark):
    table = spark.createDataFrame(rows(), SCHEMA)
    masked = secrets.mask_secrets(table)
    assert masked.columns == table.columns and masked.count() == table.count()
    by_id = {r.doc_id: r for r in masked.collect()}
    assert by_id[20].text == "x token=abc [SECRET] [SECRET] [SECRET] é password: 'éabcdef' [SECRET]"
    assert by_id[20].n_chars == len(by_id[20].text)
    assert by_id[21].text.startswith("[SECRET]'") and "0123456789abcdef" not in by_id[21].text
    clean = {repr(tuple(r)) for r in table.collect() if not base_spans(r.text) and GITHUB[:4] not in (r.text or "")}
    assert clean <= {repr(tuple(r)) for r in masked.collect()}


def test_no_python_in_the_plan(spark, edge):
    plan = secrets.secret_report(edge)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_empty_table(spark, empty):
    assert secrets.secret_report(empty).collect() == [] and secrets.mask_secrets(empty).collect() == []


def test_masking_needs_no_other_columns(spark):
    df = spark.createDataFrame([(1, "s0", "password = hunter2hunter2"), (2, None, None)], "doc_id long, source string, text string")
    got = {r.doc_id: r.text for r in secrets.mask_secrets(df).collect()}
    assert secrets.MASK in got[1] and "hunter2" not in got[1] and got[2] is None
