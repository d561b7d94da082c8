"""Relative time, ranges, bins, batches and duration expansion."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.functions.scalar import dictionary_code, floor_div
from chronomesh.operators.scaling import dense_index
from chronomesh.sources.schemas import CONN_STATUS


def relative_time(df: DataFrame, first_event: float | None = None, ts: str = "ts") -> DataFrame:
    """Shift time so that the first event is 0; the old value stays as ``abs_ts``."""
    if first_event is None:
        # one scalar; taken from the same plan with a pruned scan
        first_event = df.agg(F.min(ts)).first()[0] or 0.0
    return df.withColumns({"abs_ts": F.col(ts), ts: F.col(ts) - F.lit(first_event)})


def drop_nan_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts).isNotNull() & ~F.isnan(ts))


def time_range(df: DataFrame, lo, hi, ts: str = "ts") -> DataFrame:
    """Rows with ``lo <= ts < hi``."""
    return df.filter((F.col(ts) >= F.lit(lo)) & (F.col(ts) < F.lit(hi)))


def near_range(df: DataFrame, first_event: float, lo: float | None, hi: float | None, stored: str = "datetime") -> DataFrame:
    """Rows whose stored time may lie in ``[lo, hi]``, in seconds after ``first_event``.

    A coarse bound in whole seconds on the stored column itself, so that it reaches the scan; the exact
    filter on relative time follows.
    """
    for seconds, sign in ((lo, ">="), (hi, "<=")):
        if seconds is not None:
            at = first_event + seconds
            whole = math.floor(at) if sign == ">=" else math.ceil(at)
            edge = datetime(1970, 1, 1) + timedelta(seconds=whole)
            df = df.filter(F.expr(f"{stored} {sign} timestamp_ntz'{edge:%Y-%m-%d %H:%M:%S}'"))
    return df


def bin_events(df: DataFrame, ts: str, bin_size, batch_size: int) -> DataFrame:
    """Add ``bin_abs``, ``batch`` and ``bin`` (the bin inside its batch)."""
    bin_abs = floor_div(F.col(ts), bin_size)
    return df.withColumns({
        "bin_abs": bin_abs,
        "batch": floor_div(bin_abs, batch_size),
        "bin": F.pmod(bin_abs, F.lit(batch_size)).cast("int"),
    })


def sequential_bins(df: DataFrame, bin_column: str, batch_size: int) -> DataFrame:
    """Renumber the bins that occur to 0..n-1 and take the batch from the new number."""
    numbered = dense_index(df.select(bin_column).distinct(), [bin_column], "seq_bin")
    # every input row finds exactly one bin; a hot bin is split by AQE's skew join
    return df.join(numbered, bin_column).withColumn("seq_batch", floor_div(F.col("seq_bin"), batch_size))


def bin_spine(df: DataFrame, keys: list[str], batch_size: int) -> DataFrame:
    """One row per bin of every batch that occurs, empty bins included."""
    bins = F.sequence(F.lit(0), F.lit(batch_size - 1))
    return df.select(*keys).distinct().select(*keys, F.explode(bins).alias("bin"))


def pieces(duration: Column, bin_size) -> Column:
    """How many bins-long pieces an event of this length becomes; at least one."""
    return F.greatest(F.lit(1).cast("bigint"), F.ceil(F.coalesce(duration, F.lit(0.0)) / F.lit(bin_size)))


def expand_duration(
    df: DataFrame, bin_size, ts: str = "ts", duration: str = "duration", anchor: str = "end", keep_negative: bool = False
) -> DataFrame:
    """Repeat a long event once per bin it spans, with its state in each.

    ``ts`` is the end of the event unless ``anchor`` is "start". The last piece sits at
    the end and is "closing"; when there are more, the first is "starting" and the rest
    "open". Pieces before time 0 are dropped. Adds ``piece``, ``conn_status`` and its code.
    """
    length = F.coalesce(F.col(duration), F.lit(0.0))
    start = F.col(ts) - length if anchor == "end" else F.col(ts)
    end = F.col(ts) if anchor == "end" else F.col(ts) + length
    count = pieces(F.col(duration), bin_size)
    spread = df.withColumns({"_start": start, "_end": end, "_k": count}).withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_k") - 1))
    )
    last = F.col("piece") == F.col("_k") - 1
    status = F.when(last, "closing").when(F.col("piece") == 0, "starting").otherwise("open")
    out = spread.withColumns({
        ts: F.when(last, F.col("_end")).otherwise(F.col("_start") + F.col("piece") * F.lit(bin_size)),
        "conn_status": status,
    }).withColumn("status_code", dictionary_code(F.col("conn_status"), CONN_STATUS)).drop("_start", "_end", "_k")
    return out if keep_negative else out.filter(F.col(ts) >= 0)


def expand_range(df: DataFrame, lo, hi, bin_size, longest, ts: str = "ts", duration: str = "duration") -> DataFrame:
    """Pieces with ``lo <= ts < hi``, for events no longer than ``longest``.

    A piece lies before the end of its event, so events that end outside
    ``[lo, hi + longest)`` cannot have one in range. That bound is on the stored column and
    reaches the scan; the exact filter follows the expansion.
    """
    near = time_range(df, lo, hi + longest, ts)
    return time_range(expand_duration(near, bin_size, ts, duration), lo, hi, ts)


def without_duration(df: DataFrame) -> DataFrame:
    """The other setting: every event is one closing row."""
    return df.withColumns({"piece": F.lit(0).cast("bigint"), "conn_status": F.lit("closing"), "status_code": F.lit(2)})


def day_fold(df: DataFrame, stored: str = "datetime", ts: str = "ts") -> DataFrame:
    """Put all days on top of each other: ``ts`` becomes whole seconds since midnight."""
    t = F.col(stored)
    return df.withColumn(ts, (F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))).cast("bigint"))
