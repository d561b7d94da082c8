"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are pattern matches of several kinds. Each candidate value is hashed, and the corpus is
aggregated for the distinct repositories and owners of every hash: a value that
``example_owners`` or more owners share is a widely copied example; one that a single owner has, and that
looks random, is live; the rest is unclear. Base kinds are reported whatever their class, the
added kinds unless they are examples.

Texts never enter a shuffle for the search. A text is known by its SHA-256, so copies are
located once; a hash that very many rows hold is aggregated before it is joined.

Defined results: null texts are empty and hold nothing; a null owner or repository counts as one
more value; repeated rows are reported once each and count as one repository; empty tables stay
empty; other columns pass through unread.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.llm.store import staged, unused

MASK = "[SECRET]"
#: Owners from which a value counts as a widely copied example.
EXAMPLE_OWNERS = 3
#: Distinct characters from which a value looks random.
LIVE_CHARACTERS = 8


@dataclass(frozen=True)
class Kind:
    """``value`` is the group that holds the secret; ``hint`` is a text that every match holds, if there is one."""

    name: str
    pattern: str
    value: int = 0
    least: int = 0
    base: bool = False
    hint: str = ""


# The base kinds, in their order. Where a kind is one character class the least length stands in the pattern.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]{16,}", base=True, hint="AKIA"),
    Kind("hex", r"[0-9a-f]{24,}", base=True),
)
ADDED = (
    Kind("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Kind("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Kind("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY"),
)
KINDS = BASE + ADDED


def _clean(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def suspicious(text: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """Whether a text has a match of any kind."""
    tests = [F.contains(text, F.lit(k.hint)) & text.rlike(k.pattern) if k.hint else text.rlike(k.pattern) for k in kinds]
    return reduce(lambda a, b: a | b, tests)


def _hits_of(text: Column, rank: int, kind: Kind) -> Column:
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    if kind.hint:
        matches = F.when(F.contains(text, F.lit(kind.hint)), matches).otherwise(F.array().cast("array<string>"))
    # split gives the texts between the matches, and one more after the last
    paired = F.filter(F.zip_with(matches, F.split(text, kind.pattern, -1), lambda m, b: F.struct(m.alias("m"), b.alias("b"))),
                      lambda p: p["m"].isNotNull())
    return F.transform(paired, lambda p, i: F.struct(
        F.lit(rank).alias("rank"), i.alias("i"), F.length(p["b"]).alias("before"), F.length(p["m"]).alias("size"),
        (F.regexp_extract(p["m"], kind.pattern, kind.value) if kind.value else p["m"]).alias("value"),
    ))


def _hits(text: Column, kinds: tuple[Kind, ...]) -> Column:
    """All matches of all kinds: rank of the kind, number within it, lengths of the text before and of the match, value."""
    found = [_hits_of(text, rank, kind) for rank, kind in enumerate(kinds)]
    valued = F.transform(F.flatten(F.array(*found)), lambda h: F.struct(
        h["rank"].alias("rank"), h["i"].alias("i"), h["before"].alias("before"), h["size"].alias("size"),
        F.sha2(h["value"], 256).alias("hash"),
        reduce(lambda a, b: a & b, [(h["rank"] != r) | (F.length(h["value"]) >= k.least) for r, k in enumerate(kinds) if k.least],
               F.lit(True)).alias("valid"),
        ((F.size(F.array_distinct(F.split(h["value"], ""))) >= LIVE_CHARACTERS) & h["value"].rlike("[0-9]")
         & h["value"].rlike("[A-Za-z]")).alias("random"),
    ))
    return valued


def classified(docs: DataFrame, text_col: str, repo_col: str, owner_col: str, kinds: tuple[Kind, ...] = KINDS,
               example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(key, rank, start, end, class) of the matches of every distinct text; key is the text's SHA-256."""
    text = _clean(text_col)
    rows = docs.filter(suspicious(text, kinds)).select(
        F.sha2(text, 256).alias("key"), F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"), _hits(text, kinds).alias("hits"),
    )
    rows = staged(rows, "secret-candidates")
    # distinct (hash, owner, repository), then owners, then hashes: each step combines on the map side
    owners = (
        rows.select("repo", "owner", F.inline("hits")).filter("valid")
        .groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
        .groupBy("hash", "owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    )
    owners = staged(owners, "secret-owners")
    before = Window.partitionBy("key", "rank").orderBy("i")
    spans = (
        rows.groupBy("key").agg(F.first("hits").alias("hits")).select("key", F.inline("hits"))
        .withColumn("end", F.sum(F.col("before") + F.col("size")).over(before))
        .withColumn("start", F.col("end") - F.col("size")).filter("valid")
        .select("key", "rank", "start", "end", "hash", "random")
    )
    kind_class = (
        F.when(F.col("owners") >= example_owners, "example").when((F.col("owners") == 1) & F.col("random"), "live")
        .otherwise("unclear")
    )
    added = [r for r, k in enumerate(kinds) if not k.base]
    return (
        staged(spans, "secret-spans").join(owners, "hash")
        .select("key", "rank", "start", "end", kind_class.alias("class"))
        .filter(~(F.col("rank").isin(added) & (F.col("class") == "example")))
    )


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id",
                  owner_col: str = "source", kinds: tuple[Kind, ...] = KINDS,
                  example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, digest of the base spans, all spans, live and example counts."""
    found = classified(docs, text_col, repo_col, owner_col, kinds, example_owners)
    names = F.array(*[F.lit(k.name) for k in kinds])
    listed = F.array_sort(F.collect_list(F.struct("start", "rank", "end")))
    spans = found.groupBy("key").agg(
        listed.alias("all"), *[F.count_if(F.col("rank") == r).alias(f"n_{k.name}") for r, k in enumerate(kinds) if k.base],
        F.count_if(F.col("class") == "live").alias("n_live"), F.count_if(F.col("class") == "example").alias("n_example"),
    )

    def written(entries: Column) -> Column:
        return F.array_join(F.transform(entries, lambda s: F.concat_ws(
            ":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = [r for r, k in enumerate(kinds) if k.base]
    texts = spans.withColumn("base_sha256", F.sha2(written(F.filter("all", lambda s: s["rank"].isin(base))), 256))
    texts = texts.withColumn("spans", written(F.col("all"))).drop("all")
    counts = [f"n_{k.name}" for k in kinds if k.base] + ["n_live", "n_example"]
    text = _clean(text_col)
    empty = {**{c: F.lit(0).cast("long") for c in counts}, "base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    pair = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    plain = pair.filter(~suspicious(F.col("text"), kinds)).select("doc_id", *[v.alias(c) for c, v in empty.items()])
    keyed = pair.filter(suspicious(F.col("text"), kinds)).select("doc_id", F.sha2("text", 256).alias("key"))
    joined = keyed.join(staged(texts, "secret-texts"), "key", "left").select(
        "doc_id", *[F.coalesce(c, v).alias(c) for c, v in empty.items()]
    )
    return plain.unionByName(joined)


def mask_secrets(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source",
                 size_col: str | None = "n_chars", kinds: tuple[Kind, ...] = KINDS,
                 example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """``docs`` with every reported span replaced by ``MASK``; overlapping spans are one. ``size_col``, if there is
    such a column, follows the new text."""
    found = classified(docs, text_col, repo_col, owner_col, kinds, example_owners)
    key, cuts = unused(docs, "_key", "_cuts")
    order = Window.partitionBy("key").orderBy("start", "end")
    islands = (
        found.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("island", F.count_if(F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).over(order))
        .groupBy("key", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
        .withColumnRenamed("key", key)
    )
    text, columns = _clean(text_col), docs.columns
    touched = docs.filter(suspicious(text, kinds)).withColumn(key, F.sha2(text, 256))
    joined = touched.join(staged(islands, "secret-cuts"), key, "left")
    n = F.size(cuts)
    pieces = F.transform(F.sequence(F.lit(0), n), lambda i: F.substring(
        F.col(text_col),
        (F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"]) + 1).cast("int"),
        (F.when(i == n, F.length(text_col)).otherwise(F.get(cuts, i)["start"])
         - F.when(i == 0, 0).otherwise(F.get(cuts, i - 1)["end"])).cast("int"),
    ))
    masked = joined.withColumn(text_col, F.when(F.col(cuts).isNotNull(), F.array_join(pieces, MASK)).otherwise(F.col(text_col)))
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        masked = masked.withColumn(size_col, F.when(F.col(cuts).isNotNull(), F.length(text_col).cast(kind)).otherwise(F.col(size_col)))
    return docs.filter(~suspicious(text, kinds)).unionByName(masked.select(*columns))
