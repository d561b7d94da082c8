"""Sliding node sequences over the bins of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_timelines(
    nodes: DataFrame, batch_keys: list[str], batch_size: int, features: list[str], idle: DataFrame | None = None
) -> DataFrame:
    """One row per (batch, node) with its features in every bin.

    Where a node is silent it has its features of ``idle``, a table of one row per node, or zeros. Nodes silent
    in the whole batch have no row: theirs would be the idle one in every bin.
    The collected list has at most one entry per bin, so it is bounded by ``batch_size``
    whatever the traffic of the node; edges are reduced per bin before this.
    """
    vector = F.array(*[F.col(f).cast("double") for f in features])
    entry = F.struct(F.col("bin"), vector.alias("x"))
    grouped = nodes.groupBy(*batch_keys, "node").agg(F.map_from_entries(F.collect_list(entry)).alias("_by_bin"))
    silent = F.array_repeat(F.lit(0.0), len(features))
    if idle is not None:
        grouped = grouped.join(idle.select("node", vector.alias("_idle")), "node", "left")
        silent = F.coalesce(F.col("_idle"), silent)
    line = F.transform(
        F.sequence(F.lit(0), F.lit(batch_size - 1)),
        lambda b: F.coalesce(F.try_element_at(F.col("_by_bin"), b), silent),
    )
    return grouped.select(*batch_keys, "node", line.alias("timeline"))


def sliding_sequences(timelines: DataFrame, batch_size: int, size: int = 30, drop_last: int = 0) -> DataFrame:
    """Every run of ``size`` consecutive bins with the bin after it as ``target``.

    ``drop_last=1`` leaves out the last target. A batch too short for one window gives
    no rows. Windows never cross a batch border.
    """
    last = batch_size - 1 - drop_last
    if last < size:
        return timelines.withColumns({"target": F.lit(0), "seq": F.col("timeline")}).drop("timeline").limit(0)
    return timelines.withColumn("target", F.explode(F.sequence(F.lit(size), F.lit(last)))).withColumn(
        "seq", F.slice(F.col("timeline"), F.col("target") - size + 1, F.lit(size))
    ).drop("timeline")


def eligible_windows(spine: DataFrame, batch_keys: list[str], size: int = 30, drop_last: int = 0) -> DataFrame:
    """Batches long enough for the model, and how many targets they give."""
    counted = spine.groupBy(*batch_keys).agg(F.count("*").alias("bins"))
    return counted.filter(F.col("bins") >= size + 2).withColumns({
        "first_target": F.lit(size),
        "last_target": (F.col("bins") - 1 - drop_last).cast("int"),
        "windows": F.col("bins") - size - drop_last,
    })


def last_values(timelines: DataFrame, batch_size: int, size: int = 30, drop_last: int = 0) -> DataFrame:
    """Embedding of the model without recurrence: the features one bin before each target, straight off the timeline."""
    last = batch_size - 1 - drop_last
    rows = timelines.select(*[c for c in timelines.columns if c != "timeline"], F.posexplode("timeline").alias("target", "x"))
    return rows.withColumn("target", F.col("target") + 1).filter(F.col("target").between(size, last))


def positive_edges(edges: DataFrame, size: int = 30) -> DataFrame:
    """Edges after the warm-up window, the ones that are scored."""
    return edges.filter(F.col("bin") >= size)
