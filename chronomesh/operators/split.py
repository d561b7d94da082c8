"""Splits by batch, time shuffles and even parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.functions.scalar import floor_div
from chronomesh.operators.scaling import dense_index, hash_rank, stage

FRACTIONS = (0.6, 0.25, 0.15)


def seeded(seed: int, *keys: str) -> Column:
    """Text ``seed:key:key``; its md5 orders rows the same way on every engine."""
    return F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])


def split_batches(batches: DataFrame, by: list[str], fractions=FRACTIONS, seed: int = 42, batch: str = "batch") -> DataFrame:
    """Assign each distinct batch to stage 0, 1 or 2, separately per ``by`` group.

    Part sizes are floor(fraction * n), with the remainder given out one by one from the
    first part. The window runs over distinct batches, one row per batch length of
    calendar time, not over events.
    """
    distinct = batches.select(*by, batch).distinct()
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranked = distinct.withColumns({
        "_r": F.row_number().over(group.orderBy(F.md5(seeded(seed, *by, batch)))),
        "_n": F.count("*").over(group),
    })
    base = [F.floor(F.col("_n") * F.lit(f)) for f in fractions]
    spare = F.col("_n") - sum(base[1:], base[0])
    cut1 = base[0] + F.when(spare >= 1, 1).otherwise(0)
    cut2 = cut1 + base[1] + F.when(spare >= 2, 1).otherwise(0)
    code = F.when(F.col("_r") <= cut1, 0).when(F.col("_r") <= cut2, 1).otherwise(2)
    return ranked.select(*by, batch, code.alias("stage"))


def split_sizes(split: DataFrame, by: list[str] | None = None) -> DataFrame:
    return split.groupBy(*(by or []), "stage").agg(F.count("*").alias("batches"))


def with_stage(events: DataFrame, split: DataFrame, keys: list[str]) -> DataFrame:
    """Look up each event's stage. The split is staged, so its real size decides the join."""
    return events.join(stage(split, "split"), keys)


def stage_events(events: DataFrame, split: DataFrame, keys: list[str], code: int) -> DataFrame:
    """Events of one stage. Written in (batch, bin) order by the sinks, not sorted here."""
    return events.join(stage(split.filter(F.col("stage") == code), "split"), keys)


def shuffle_orders(df: DataFrame, seed: int = 42, key: str = "conn_id") -> DataFrame:
    """``df`` with its rank in two md5 orders, ``_take`` and ``_give``; written once, as every shuffle of it reads both.

    Both orders come from a unique key and depend on no bin width, so several widths share them.
    """
    keyed = stage(df, "shuffle-rows")
    taken = stage(hash_rank(keyed, seeded(seed, key), "_take"), "shuffle-taken")
    return stage(hash_rank(taken, seeded(seed + 1, key), "_give"), "shuffle-orders")


def swap_bins(ordered: DataFrame, width: float, ts: str = "ts") -> DataFrame:
    """The row at rank i of one order takes the bin of the row at rank i of the other and keeps its offset inside its bin."""
    own = floor_div(F.col(ts), width)
    givers = ordered.select(F.col("_give").alias("_take"), own.alias("_new"))
    moved = F.col(ts) - own * F.lit(width) + F.col("_new") * F.lit(width)
    return ordered.join(givers, "_take").withColumn(ts, moved).drop("_take", "_give", "_new")


def random_time_shuffle(df: DataFrame, width: float, seed: int = 42, key: str = "conn_id", ts: str = "ts") -> DataFrame:
    """Permute the time bins across rows; each row keeps its offset inside its bin.

    No bin, however full, lands in one task.
    """
    return swap_bins(shuffle_orders(df, seed, key), width, ts)


def bin_permutation_shuffle(df: DataFrame, width: float, seed: int = 42, ts: str = "ts") -> DataFrame:
    """Move whole bins: every row of a bin gets the same new bin."""
    binned = df.withColumn("_bin", floor_div(F.col(ts), width))
    bins = stage(binned.select("_bin").distinct(), "bins")
    taker = hash_rank(bins, seeded(seed, "_bin"), "_rank")
    giver = hash_rank(bins.select(F.col("_bin").alias("_new")), seeded(seed + 1, "_new"), "_rank")
    mapping = stage(taker.join(giver, "_rank").select("_bin", "_new"), "bin-permutation")
    offset = F.col(ts) - F.col("_bin") * F.lit(width)
    return binned.join(mapping, "_bin").withColumn(ts, offset + F.col("_new") * F.lit(width)).drop("_bin", "_new")


def even_parts(df: DataFrame, parts: int, order_by: list[str], name: str = "part") -> DataFrame:
    """Cut the sorted rows into ``parts`` runs of nearly equal size, larger ones first."""
    indexed = dense_index(df, order_by, "_at")
    total = indexed.count()
    small, large = divmod(total, parts)
    edge = large * (small + 1)
    pos = F.col("_at")
    tail = F.lit(large) + F.floor((pos - edge) / F.lit(max(small, 1)))
    head = F.floor(pos / F.lit(small + 1))
    return indexed.withColumn(name, F.when(pos < edge, head).otherwise(tail).cast("int")).drop("_at")
