from datetime import date, timedelta

from chronomesh.llm import url_filter
from chronomesh.llm.queries_url import op5_url_temporal_list

DAY = date(2024, 1, 1)
on = lambda n: DAY + timedelta(n)
ENTRIES = [
    ("adult", "domain", "Bad.example", "add", on(10)), ("adult", "domain", "bad.example", "add", on(12)), ("adult", "domain", "bad.example", "remove", on(20)),
    ("adult", "domain", "bad.example", "remove", on(22)), ("adult", "domain", "bad.example", "add", on(30)), ("spam", "host", "a.bad.example", "add", on(15)),
    ("spam", "host", "a.bad.example", "add", on(15)), ("spam", "host", "tie.example", "add", on(5)), ("spam", "host", "tie.example", "remove", on(5)),
    ("spam", "host", "never.example", "remove", on(1)), (None, "host", "x.example", "add", on(1)), ("spam", "host", None, "add", on(1)),
    ("spam", "host", "x.example", "add", None), ("spam", "host", "x.example", "rename", on(1)),
]
URLS = [
    "http://bad.example/x", "https://u:p@A.BAD.example.:8080/?q#f", "http://b.a.bad.example", "http://notbad.example", "http://tie.example/", "http://never.example/",
    "http://x.example/", None, "", "no url", "http://" + "long." * 60 + "bad.example/", "ftp://bad.example",
]


def brute(url, day):
    host = url_filter_host(url)
    if host is None or day is None:
        return host, ""
    state = {}
    valid = [e for e in ENTRIES if None not in e and e[3] in ("add", "remove") and e[4] <= day]
    for category, kind, pattern, action, _ in sorted(valid, key=lambda e: (e[4], e[3] == "add")):
        state[category, kind, pattern.lower()] = action == "add"
    hits = {c for (c, kind, p), active in state.items() if active and (host == p or kind == "domain" and host.endswith("." + p))}
    return host, ",".join(sorted(hits))


def url_filter_host(url):
    if not url or "://" not in url:
        return None
    host = url.lower().split("://", 1)[1].split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].removesuffix(".")
    return host if 0 < len(host) <= 253 else None


def test_verdicts_equal_brute_force(spark):
    captures = [(i * 100 + d, u, None if d == 40 else on(d), "clash") for i, u in enumerate(URLS) for d in range(0, 41)] * 2
    table = spark.createDataFrame(captures, "page_id long, url string, fetch_date date, host string").repartition(3)
    entries = spark.createDataFrame(ENTRIES, "category string, kind string, pattern string, action string, date date")
    got = url_filter.judge(table, entries).collect()
    want = [(i, *brute(u, d)) for i, u, d, _ in captures]
    assert sorted(repr((r.page_id, r.host, r.categories)) for r in got) == sorted(map(repr, want))
    assert all(r.blocked == (r.n_entries > 0) == bool(r.categories) for r in got)


def test_intervals(spark):
    entries = spark.createDataFrame(ENTRIES, "category string, kind string, pattern string, action string, date date")
    got = {(r.pattern, r.valid_from, r.valid_to) for r in url_filter.intervals(entries).collect()}
    assert got == {("bad.example", on(10), on(20)), ("bad.example", on(30), None), ("a.bad.example", on(15), None), ("tie.example", on(5), None)}


def test_empty_tables(spark):
    entries = spark.createDataFrame([], "category string, kind string, pattern string, action string, date date")
    table = spark.createDataFrame([(1, "http://a.b", on(1))], "page_id long, url string, fetch_date date")
    assert [r.blocked for r in url_filter.judge(table, entries).collect()] == [False]
    assert url_filter.judge(table.limit(0), entries).collect() == []


def test_the_query_blocks_some_pages(spark, tiny):
    counts = {r["blocked"]: r["count"] for r in op5_url_temporal_list(spark, tiny).groupBy("blocked").count().collect()}
    assert min(counts.get(True, 0), counts.get(False, 0)) > 0
