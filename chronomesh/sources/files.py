"""Readers and writers: parquet, headerless CSV, JSON records, multi-file data sets."""

from __future__ import annotations

import csv
import json
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronomesh.functions.scalar import dictionary_code
from chronomesh.operators.timebin import relative_time


def read_parquet(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Parquet with a declared schema; only the named columns reach the scan."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def read_manifest(spark: SparkSession, manifest: dict[str, int], schema: T.StructType, id_name: str = "file_id") -> DataFrame:
    """A list of files or folders as one data set; every row knows the number of its file.

    The path of a row comes from the scan's own metadata, so all files are one scan. A row belongs to the
    longest entry that its path ends with or lies in, at the borders of path parts; a row that belongs to none
    fails the job.
    """
    rows = spark.read.schema(schema).parquet(*manifest).select("*", F.col("_metadata.file_path").alias("_path"))
    clean = lambda p: "/" + re.sub(r"^[a-z]+:/*", "", p).strip("/")
    entries = sorted(((clean(p), n) for p, n in manifest.items()), key=lambda e: len(e[0]))
    place = F.concat(F.lit("/"), F.regexp_replace("_path", "^[a-z]+:/*", ""), F.lit("/"))
    # one map literal and one array literal, folded once, whatever the number of files
    numbers = F.from_json(F.lit(json.dumps(dict(entries))), "map<string,int>")
    paths = F.split(F.lit("\n".join(p for p, _ in entries)), "\n")
    own = F.filter(paths, lambda p: F.contains(place, F.concat(p, F.lit("/"))))
    number = F.element_at(numbers, F.element_at(own, -1))
    known = F.when(F.size(own) > 0, number).otherwise(F.raise_error(F.concat(F.lit("not in the manifest: "), "_path")).cast("int"))
    return rows.withColumn(id_name, known).drop("_path")


def read_numbered(spark: SparkSession, path: str, partition: str, schema: T.StructType, id_name: str = "file_id") -> DataFrame:
    """A folder with one sub-folder ``partition=number`` per file; the number comes from the folder's name.

    Plan and driver hold nothing per file, so this is the way for very many files.
    """
    whole = T.StructType([*[f for f in schema.fields if f.name != partition], T.StructField(partition, T.IntegerType())])
    return spark.read.schema(whole).parquet(path).withColumn(id_name, F.col(partition)).drop(partition)


def write_parquet(
    df: DataFrame, path: str, partition_by: list[str] | None = None, order_by: list[str] | None = None,
    compression: str = "zstd", row_group_bytes: int = 128 << 20,
) -> str:
    """Parquet sink. ``order_by`` range-partitions first, so files hold disjoint ranges and
    readers can skip row groups by their statistics.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    writer = df.write.option("compression", compression).option("parquet.block.size", row_group_bytes)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.mode("overwrite").parquet(path)
    return path


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is at ``path``; a crashed write does not count."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    marker = hadoop.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def materialize_once(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write ``df`` to ``path`` unless a complete table is there already, and read it."""
    spark = df.sparkSession
    if force or not is_complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> str:
    """Headerless gzip CSV."""
    df.write.mode("overwrite").option("header", False).option("compression", "gzip").csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless CSV with given names and types; a malformed line fails the job."""
    return spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)


def read_csv_until(spark: SparkSession, path: str, schema: T.StructType, limit, ts: str = "time") -> DataFrame:
    """CSV rows up to and including a time."""
    return read_csv(spark, path, schema).filter(F.col(ts) <= F.lit(limit))


def _parts(spark: SparkSession, path: str) -> list:
    """Data files below ``path`` in the order of their names, as Hadoop paths."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return [s.getPath() for s in sorted(found, key=lambda s: s.getPath().getName()) if s.isFile() and s.getPath().getName()[0] not in "_."]


def _first_line(spark: SparkSession, part) -> str | None:
    """The first line of a part, unpacked by the codec its name asks for; any store that Spark reads will do."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    raw = part.getFileSystem(conf).open(part)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(part)
        stream = raw if codec is None else codec.createInputStream(raw)
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine()
    finally:
        raw.close()


def parts_until(spark: SparkSession, path: str, schema: T.StructType, limit, ts: str = "time") -> list[str]:
    """The parts of a time-ordered log that can hold rows up to ``limit``; it stops at the first part that begins after it.

    Parts follow each other in the order of their names. Of each part one line is looked at, and of those behind the
    first that begins after ``limit`` none.
    """
    kept, place = [], schema.names.index(ts)
    for part in _parts(spark, path):
        line = _first_line(spark, part)
        if line and float(next(csv.reader([line]))[place]) > limit:
            break
        kept.append(part.toString())
    return kept


def read_csv_ordered_until(spark: SparkSession, path: str, schema: T.StructType, limit, ts: str = "time") -> DataFrame:
    """CSV rows up to and including a time, from a log in time-ordered parts: later parts are not opened.

    Unlike ``read_csv_until``, which reads the whole log whatever its order. The last part kept is read to its end.
    """
    parts = parts_until(spark, path, schema, limit, ts)
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(parts).filter(F.col(ts) <= F.lit(limit))


def csv_to_parquet(
    spark: SparkSession, csv_path: str, parquet_path: str, schema: T.StructType,
    dictionaries: dict[str, list[str]], order_by: list[str], row_group_bytes: int = 128 << 20, compression: str = "zstd",
) -> DataFrame:
    """Convert a log to parquet in time order; a value outside its dictionary fails the job."""
    df = read_csv(spark, csv_path, schema)
    for name, values in dictionaries.items():
        checked = F.when(dictionary_code(F.col(name), values).isNotNull(), F.col(name))
        df = df.withColumn(name, checked)
    write_parquet(df, parquet_path, order_by=order_by, compression=compression, row_group_bytes=row_group_bytes)
    return spark.read.schema(schema).parquet(parquet_path)


def write_records(df: DataFrame, path: str) -> str:
    """JSON record sink, one record per line."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


@dataclass(frozen=True)
class DataSet:
    """Rows with a time ``ts`` and a file number; ``first_event`` is the earliest time unless it is known."""

    rows: DataFrame
    first_event: float | None = None


def combine(datasets: dict[str, DataSet], name: str = "dataset", file_id: str = "file_id", ts: str = "ts") -> DataFrame:
    """Several data sets under one label space; ``name`` says where a row is from.

    Time starts at 0 in each of them, and file numbers carry the data set's name, so they never collide.
    """
    parts = []
    for label, one in datasets.items():
        named = F.concat(F.lit(f"{label}-"), F.col(file_id).cast("string"))
        moved = relative_time(one.rows, one.first_event, ts).drop("abs_ts")
        parts.append(moved.withColumns({name: F.lit(label), file_id: named}))
    return reduce(DataFrame.unionByName, parts)
