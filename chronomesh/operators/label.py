"""Labels: red-team matches and class flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronomesh.operators.scaling import stage

_PLACE = ["time", "src_computer", "dst_computer"]


def label_redteam(events: DataFrame, redteam: DataFrame, staged: bool = True) -> DataFrame:
    """Add ``malicious``: the listed user acted at that time between these computers,
    as source or as destination user. Repeated list rows cannot multiply events.

    The list becomes one row per time and computers with its users, so both sides of an event are settled by one join: the log
    is exchanged once, or not at all while the list is under the broadcast threshold.
    """
    listed = redteam.groupBy(*[F.col(k).alias(f"_{k}") for k in _PLACE]).agg(F.collect_set("user_name").alias("_users"))
    if staged:
        listed = stage(listed, "redteam")
    out = events.join(listed, [F.col(k) == F.col(f"_{k}") for k in _PLACE], "left")
    acted = [F.array_contains("_users", F.col(f"{side}_user")) for side in ("src", "dst")]
    hit = F.coalesce(acted[0], F.lit(False)) | F.coalesce(acted[1], F.lit(False))
    return out.withColumn("malicious", hit).drop("_users", *[f"_{k}" for k in _PLACE])


def is_malicious(label: str = "label_tactic", benign: str = "none") -> Column:
    """Any class but the benign one, a missing class included."""
    return ~F.col(label).eqNullSafe(F.lit(benign))


def malicious_flag(df: DataFrame, label: str = "label_tactic", benign: str = "none") -> DataFrame:
    """Add ``mal``."""
    return df.withColumn("mal", is_malicious(label, benign))


def log_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn("ts_log", F.log1p(ts))
