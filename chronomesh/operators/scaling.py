"""Building blocks that keep numbering and running totals off any single task.

A global ``row_number`` or running sum over raw rows would send the whole table through
one window partition. The helpers here range-partition (or hash-partition) the rows
first, total each partition, and add the offsets of the partitions before it. What one
task holds is then set by the number of partitions, never by a hot key.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id keeps the row position in the low 33 bits.
_POSITION_MASK = (1 << 33) - 1


_LOCAL: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which every executor must reach.

    The setting belongs to the session's builder; a running session cannot take it. Where a local session leaves it unset, as in
    tests, one temporary folder of this process stands in; on a cluster that raises.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir, when the session is built, to a folder every executor can reach")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="chronomesh-"))
    return _LOCAL[0]


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables of this application. Whoever runs the application removes it afterwards."""
    return f"{checkpoint_folder(spark)}/chronomesh-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage in a way that survives the loss of executors, computes a
    shared input once, and tells Catalyst the true size, so that a later join is
    broadcast only when the table is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dense_index(df: DataFrame, order_by: list[str | Column], name: str) -> DataFrame:
    """Number the rows 0..n-1 in the given total order.

    Range partition, sort inside the partitions, keep (partition, position), then add the
    sizes of the earlier partitions. The offsets collected on the driver are one number
    per partition.
    """
    placed = (
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_mid", 33).cast("int"))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit(_POSITION_MASK)))
        .drop("_mid")
    )
    staged = stage(placed, "dense-index")
    sizes = {r["_part"]: r["n"] for r in staged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(part, 0)
    if not starts:
        starts = [0]
    # one text literal, folded to an array once, whatever the number of partitions
    offsets = F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>")
    return staged.withColumn(name, F.element_at(offsets, F.col("_part") + 1) + F.col("_pos")).drop("_part", "_pos")


def hash_rank(df: DataFrame, text: Column, name: str, digits: int = 4) -> DataFrame:
    """Rank rows 0..n-1 by the md5 of ``text``, which must be unique.

    Equal to ``row_number() over (order by md5(text)) - 1``. The first hex digits form
    buckets of nearly equal size whatever the data looks like; their offsets are a table
    of at most ``16 ** digits`` rows, which is why it may be broadcast.
    """
    if not 1 <= digits <= 4:
        raise ValueError("digits must be 1 to 4: the offsets are broadcast")
    keyed = df.withColumn("_md5", F.md5(text)).withColumn("_bucket", F.substring("_md5", 1, digits))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("_bucket").agg(F.count("*").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_bucket").orderBy("_md5")
    return (
        keyed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_start") + F.row_number().over(inside) - 1)
        .drop("_md5", "_bucket", "_start")
    )


def running_sums(
    df: DataFrame,
    groups: list[str],
    order_by: list[str],
    values: dict[str, str],
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums ``{new column: value column}`` inside each group.

    ``groups`` + ``order_by`` must identify a row (aggregate first). A group may be
    larger than a task: it is spread over as many ranges as its size asks for. Nulls form a group.
    """
    ordering = [F.col(c).desc() if descending else F.col(c) for c in order_by]
    ranged = df.repartitionByRange(*[F.col(g) for g in groups], *ordering).withColumn("_part", F.spark_partition_id())
    staged = stage(ranged, "running-sums")
    keys = ["_part", *groups]
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        staged.groupBy(*keys).agg(*[F.sum(v).alias(f"_t_{n}") for n, v in values.items()])
        .select(*keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in values])
    )
    inside = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_s_{n}" for n in values])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = staged.join(starts, same)
    return joined.select(
        *df.columns,
        *[(F.col(f"_s_{n}") + F.sum(v).over(inside)).alias(n) for n, v in values.items()],
    )
