"""URL filters by temporal list join.

A dated list is a log of entries (category, kind, pattern, action, date): ``add`` puts a pattern on the list,
``remove`` takes it off. Entries become validity intervals [from, to), and every capture is judged by the entries
that were active when it was fetched. Kind ``host`` is one host, ``domain`` a host and all hosts below it.

Captures are first reduced to distinct (host, date) on the map side, then joined as of their date, and the
verdicts are joined back, so a host with very many captures meets the list once a day. Both
joins are plain equi-joins that Spark can split where a key is hot. A host has few names above
it, since longer ones than 253 characters are no hosts.

Defined results: a null URL, or one without a valid host, has host null and is never listed; a null date is
before every entry; entries without category, kind, pattern, action or date are void; repeated entries and an
``add`` while active (or ``remove`` while not) change nothing; of entries at the same date for one pattern ``remove``
comes before ``add``; empty tables give no entry or no capture; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.store import staged

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
LONGEST_HOST = 253


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and closing dot; null if there is none."""
    host = F.regexp_replace(F.regexp_extract(F.lower(F.trim(url)), HOST, 1), r"\.$", "")
    return F.when((F.length(host) > 0) & (F.length(host) <= LONGEST_HOST), host)


def intervals(entries: DataFrame) -> DataFrame:
    """(category, kind, pattern, valid_from, valid_to); valid_to is null while the entry is active."""
    rows = entries.select("category", "kind", F.lower("pattern").alias("pattern"), F.lower("action").alias("action"), "date").dropna()
    # one state a pattern and date: active unless only removed; the list's length is then that of the calendar
    states = (
        rows.filter(F.col("action").isin("add", "remove")).groupBy("category", "kind", "pattern", "date")
        .agg(F.max(F.col("action") == "add").alias("active"))
    )
    order = Window.partitionBy("category", "kind", "pattern").orderBy("date")
    changes = states.withColumn("was", F.coalesce(F.lag("active").over(order), F.lit(False))).filter("active <> was")
    return (
        changes.withColumn("valid_to", F.lead("date").over(order)).filter("active")
        .select("category", "kind", "pattern", F.col("date").alias("valid_from"), "valid_to")
    )


def _names(host: Column) -> Column:
    """(kind, pattern) of everything that a list may hold against a host."""
    labels = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"))), above)


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", date_col: str = "fetch_date") -> DataFrame:
    """(id, host, fetch date, n_entries, categories, blocked) of every capture; categories in order, joined by commas."""
    rows = captures.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), F.col(date_col).alias("fetch_date"))
    spans = staged(intervals(entries), "list-intervals")
    visits = rows.filter(F.col("host").isNotNull() & F.col("fetch_date").isNotNull()).select("host", "fetch_date").distinct()
    named = staged(visits.select("host", "fetch_date", F.inline(_names(F.col("host")))), "list-visits")
    active = named.join(spans, ["kind", "pattern"]).filter(
        (F.col("fetch_date") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_date") < F.col("valid_to"))))
    verdicts = staged(active.groupBy("host", "fetch_date").agg(
        F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")), "list-verdicts")
    return rows.join(verdicts, ["host", "fetch_date"], "left").select(
        id_col, "host", "fetch_date", F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce(F.col("n_entries") > 0, F.lit(False)).alias("blocked"),
    )
