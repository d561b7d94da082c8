"""Descriptive statistics over binned events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.scalar import stage_name
from chronomesh.operators.scaling import running_sums, stage
from chronomesh.operators.timebin import bin_spine


def dataset_summary(df: DataFrame, dataset: str, ts: str, ends: list[str]) -> DataFrame:
    """First and last event, length, events and distinct hosts (null is one host) per dataset."""
    totals = df.groupBy(dataset).agg(
        F.min(ts).alias("first_event"),
        F.max(ts).alias("last_event"),
        (F.max(ts) - F.min(ts)).alias("length"),
        F.count("*").alias("events"),
    )
    named = [F.coalesce(F.col(c), F.lit("None")) for c in ends]
    hosts = (
        df.select(dataset, F.explode(F.array(*named)).alias("_host")).distinct()
        .groupBy(dataset).agg(F.count("*").alias("unique_hosts"))
    )
    hosts = hosts.withColumnRenamed(dataset, "_dataset")
    return totals.join(hosts, totals[dataset].eqNullSafe(hosts["_dataset"])).drop("_dataset")


def label_counts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    return df.groupBy(*keys, label).agg(F.count("*").alias("events"))


#: Where events of a class that is not listed, or of none, are counted.
OTHER = "other"


def listed_class(label: str, labels: list[str]) -> Column:
    """The class if it is listed, else ``OTHER``."""
    return F.when(F.col(label).isin(labels), F.col(label)).otherwise(F.lit(OTHER))


def label_pivot(counts: DataFrame, key: str, label: str, labels: list[str]) -> DataFrame:
    """One column per class, zero where a class is missing, and ``OTHER`` for the rest: a row adds up to its events.

    Labels are given, so no extra pass.
    """
    named = counts.withColumn(label, listed_class(label, labels))
    sums = [F.coalesce(F.sum(F.when(F.col(label) == v, F.col("events"))), F.lit(0)).alias(v) for v in [*labels, OTHER]]
    return named.groupBy(key).agg(*sums)


def label_cumulative(counts: DataFrame, key: str, label: str, labels: list[str]) -> DataFrame:
    """Running total per class, ``OTHER`` included, over the batches that occur, long form.

    The frame runs per class over the aggregated table, one row per batch.
    """
    named = counts.groupBy(key, listed_class(label, labels).alias(label)).agg(F.sum("events").alias("events"))
    grid = counts.select(key).distinct().select(F.col(key).alias("_key"), F.explode(F.lit([*labels, OTHER])).alias("_label"))
    same = named[key].eqNullSafe(grid["_key"]) & (named[label] == grid["_label"])
    filled = grid.join(named, same, "left").select(
        F.col("_key").alias(key), F.col("_label").alias(label), F.coalesce("events", F.lit(0)).alias("events"))
    upto = Window.partitionBy(label).orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return filled.withColumn("cumulative", F.sum("events").over(upto))


def bucket_counts(df: DataFrame, ts: str, width) -> DataFrame:
    return (
        df.groupBy(F.floor(F.col(ts) / F.lit(width)).alias("bucket")).agg(F.count("*").alias("events"))
        .orderBy(F.desc("events"), "bucket")
    )


#: Low bits of a position hold the bin number, the bits above them the data file.
_BIN_BITS = 40


def bin_position(batch_keys: list[str], batch_size: int) -> Column:
    """Place of a bin in processing order as one number: file, then batch, then bin.

    One number keeps ``min`` over it a hash aggregate; a struct would need a sort.
    """
    within = F.col("batch") * F.lit(batch_size) + F.col("bin")
    files = [k for k in batch_keys if k != "batch"]
    if len(files) > 1:
        raise ValueError(f"one file key fits into a position, not {files}")
    return F.shiftleft(F.col(files[0]).cast("bigint"), _BIN_BITS) + within if files else within


def from_position(position: Column, batch_keys: list[str], batch_size: int) -> list[Column]:
    """The columns a position was made from."""
    files = [k for k in batch_keys if k != "batch"]
    within = position.bitwiseAND(F.lit((1 << _BIN_BITS) - 1)) if files else position
    out = [F.shiftright(position, _BIN_BITS).cast("int").alias(files[0])] if files else []
    return [*out, F.floor(within / batch_size).alias("batch"), F.pmod(within, F.lit(batch_size)).cast("int").alias("bin")]


def first_seen(df: DataFrame, position: Column, columns: list[str], pairs: dict[str, list[list[str]]]) -> DataFrame:
    """First position of every value: (field number, value, position).

    Each event is unpivoted once; ``min`` combines on the map side, so a value that fills
    a third of the rows still shuffles one row per task.
    """
    cells = [F.struct(F.lit(i).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(columns)]
    for i, ends in enumerate(pairs.values(), len(columns)):
        for end in ends:
            present = F.col(end[0]).isNotNull()
            joined = F.concat_ws("|", *[F.col(c).cast("string") for c in end]) if len(end) > 1 else F.col(end[0]).cast("string")
            cells.append(F.struct(F.lit(i).alias("field"), F.when(present, joined).alias("value")))
    flat = df.select(position.alias("_at"), F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    return flat.groupBy("field", "value").agg(F.min("_at").alias("_at"))


def novelty(
    df: DataFrame, batch_keys: list[str], batch_size: int, columns: list[str], pairs: dict[str, list[list[str]]]
) -> DataFrame:
    """How many values each bin shows for the first time, per field; all bins are listed.

    Order of processing is ``batch_keys`` then ``bin``; times are not negative.
    """
    order = [*batch_keys, "bin"]
    fields = [*columns, *pairs]
    seen = first_seen(df, bin_position(batch_keys, batch_size), columns, pairs)
    per_bin = seen.groupBy("_at").agg(*[F.count_if(F.col("field") == i).alias(f"new_{f}") for i, f in enumerate(fields)])
    counts = per_bin.select(*from_position(F.col("_at"), batch_keys, batch_size), *[f"new_{f}" for f in fields])
    spine = bin_spine(df, batch_keys, batch_size)
    return spine.join(counts, order, "left").na.fill(0, [f"new_{f}" for f in fields])


def novelty_cumulative(novel: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """Distinct values seen so far, per bin."""
    return running_sums(novel, [], order, {f"seen_{f}": f"new_{f}" for f in fields})


def novelty_by_stage(novel: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """The novelty curve with bins reordered by stage; ``position`` counts from 0."""
    sums = {f"seen_{f}": f"new_{f}" for f in fields}
    ranked = running_sums(novel.withColumn("_one", F.lit(1)), [], ["stage", *order], {**sums, "position": "_one"})
    return ranked.withColumn("position", F.col("position") - 1).drop("_one")


def stage_ranges(curve: DataFrame) -> DataFrame:
    """First and last position of each stage, with its name."""
    return curve.groupBy("stage").agg(F.min("position").alias("x_start"), F.max("position").alias("x_end")).withColumn(
        "stage_name", stage_name(F.col("stage"))
    )


def time_quartiles(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Exact quartiles per group.

    Equal values are counted first, so the percentile's buffer holds one entry per
    distinct bin instead of one per event.
    """
    counted = df.groupBy(*groups, value).agg(F.count("*").alias("_n"))
    return counted.groupBy(*groups).agg(
        F.sum("_n").alias("events"),
        F.percentile(value, [0.25, 0.5, 0.75], F.col("_n")).alias("_q"),
    ).select(*groups, "events", *[F.col("_q")[i].alias(name) for i, name in enumerate(("q1", "median", "q3"))])


def time_histogram(df: DataFrame, groups: list[str], value: str, width) -> DataFrame:
    return df.groupBy(*groups, F.floor(F.col(value) / F.lit(width)).alias("bucket")).agg(F.count("*").alias("events"))


def time_density(df: DataFrame, groups: list[str], value: str, step: float = 1.0, reach: float = 4.0) -> DataFrame:
    """(groups, point, density): Gaussian kernel density of ``value`` per group, on a grid of distance ``step``.

    Equal values are counted first. The width is Silverman's, 0.9 min(deviation, quartile range / 1.34) n ** -0.2, from the
    weighted moments of the counts, at least half a grid step. Every value is spread over the grid points within ``reach`` widths
    of it, and what it gives adds up to its count, so the densities of a group add up to 1 / ``step`` whatever is cut off. Work is
    distinct values x points in reach. Values null or not finite are left out.
    """
    finite = F.col(value).isNotNull() & (F.abs(F.col(value).cast("double")) < F.lit(float("inf")))
    counted = stage(df.filter(finite).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")), "density-counts")
    moments = counted.groupBy(*groups).agg(
        F.sum("_n").alias("_total"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("_mean"),
        F.percentile("_v", [0.25, 0.75], F.col("_n")).alias("_q"))
    groups_on = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups] or F.lit(True)

    def beside(table: DataFrame) -> DataFrame:
        return table.select(*[F.col(g).alias(f"_g_{g}") for g in groups], *[c for c in table.columns if c not in groups])

    helpers = [f"_g_{g}" for g in groups]
    off = F.col("_v") - F.col("_mean")
    spread = counted.join(beside(moments), groups_on).drop(*helpers).groupBy(*groups).agg(
        F.first("_total").alias("_total"), F.first("_q").alias("_q"), F.sqrt(F.sum(off * off * F.col("_n")) / F.sum("_n")).alias("_dev"))
    quartile = (F.col("_q")[1] - F.col("_q")[0]) / 1.34
    scale = F.when(quartile > 0, F.least("_dev", quartile)).otherwise(F.col("_dev"))
    widths = spread.select(*groups, "_total", F.greatest(0.9 * scale * F.pow("_total", F.lit(-0.2)), F.lit(step / 2)).alias("_h"))
    near = F.sequence(F.ceil((F.col("_v") - reach * F.col("_h")) / step).cast("bigint"), F.floor((F.col("_v") + reach * F.col("_h")) / step).cast("bigint"))
    kernel = F.transform(near, lambda k: F.exp(-F.pow((k * F.lit(step) - F.col("_v")) / F.col("_h"), 2) / 2))
    given = counted.join(beside(widths), groups_on).drop(*helpers).withColumns({"_k": near, "_w": kernel})
    given = given.withColumn("_sum", F.aggregate("_w", F.lit(0.0), lambda a, b: a + b))
    points = given.select(*groups, "_n", "_total", "_sum", F.inline(F.arrays_zip("_k", "_w")))
    return points.groupBy(*groups, (F.col("_k") * F.lit(step)).alias("point")).agg(
        F.sum(F.col("_n") * F.col("_w") / F.col("_sum") / F.col("_total") / F.lit(step)).alias("density"))


def class_balance(edges: DataFrame, keys: list[str], label: str, warmup: int, floor: float = 0.2) -> DataFrame:
    """Malicious and benign edges per batch, and the malicious share of the scored ones."""
    scored = F.col("bin") >= warmup
    bad = F.col(label) > 0
    return edges.groupBy(*keys).agg(
        F.count_if(bad).alias("malicious"),
        F.count_if(~bad).alias("benign"),
        F.count_if(scored).alias("scored"),
        F.count_if(scored & bad).alias("scored_malicious"),
    ).withColumn(
        "share",
        F.when(F.col("scored") > 0, F.greatest(F.col("scored_malicious") / F.col("scored"), F.lit(floor))),
    )


def running_mean(df: DataFrame, groups: list[str], step: str, value: str) -> DataFrame:
    """Mean of a per-step metric over the steps so far."""
    upto = Window.partitionBy(*groups).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(f"mean_{value}", F.avg(value).over(upto))


def mean_over_windows(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean of per-window metrics over the windows of a batch."""
    return df.groupBy(*keys).agg(F.count("*").alias("windows"), *[F.avg(v).alias(f"mean_{v}") for v in values])
