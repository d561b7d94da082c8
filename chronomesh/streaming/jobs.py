"""Structured Streaming versions of four operators.

All append to a parquet sink with a checkpoint, so a job can be killed and started again.
State is bounded by the watermark: open bins only. ``novelty`` alone also keeps the known values, until they expire.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chronomesh.operators.label import is_malicious, label_redteam
from chronomesh.sources import schemas
from chronomesh.sources.views import conn_from_events


def read_conn_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Connections as a stream over an event table: a folder of files, or one file.

    ``event_time`` carries the watermark. ``files_per_trigger`` sets the pace only.
    """
    reader = spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern that matches this name only: the reader then takes a file as well as a folder
    path = path.rstrip("/")
    events = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    return conn_from_events(events).withColumn("event_time", F.timestamp_seconds("ts"))


def run_to_table(stream: DataFrame, out: str, state: str) -> DataFrame:
    """Process everything that is available, then return what the sink at ``out`` holds.

    ``state`` holds the progress. Started again with the same two folders, a job goes on where it stopped.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", state).trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def bin_stats(stream: DataFrame, bin_size: int, delay: str = "1 hour") -> DataFrame:
    """Events, bytes and malicious events per tumbling bin."""
    return (
        stream.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", f"{bin_size} seconds").alias("w"))
        .agg(
            F.count("*").alias("events"),
            F.sum("orig_bytes").alias("orig_bytes"),
            F.count_if(is_malicious()).alias("malicious"),
        )
        .select(F.unix_seconds("w.start").alias("bin_start"), "events", "orig_bytes", "malicious")
    )


def value_sightings(stream: DataFrame, bin_size: int, fields: dict[str, list[str]], delay: str = "1 hour", keep_window: bool = False) -> DataFrame:
    """Each (bin, field, value) once, when its bin closes.

    Partial aggregation in front of the state store turns a hot value into one row per
    task. No ever-growing set of known values is kept in the stream; ``novelty_from_sightings``
    finds first appearances in the compact output.
    """
    cells = [
        F.struct(F.lit(field).alias("field"), F.col(c).cast("string").alias("value"))
        for field, columns in fields.items() for c in columns
    ]
    flat = stream.withWatermark("event_time", delay).select("event_time", F.inline(F.array(*cells)))
    return (
        flat.filter(F.col("value").isNotNull())
        .groupBy(F.window("event_time", f"{bin_size} seconds").alias("w"), "field", "value")
        .agg(F.count("*").alias("events"))
        .select(F.unix_seconds("w.start").alias("bin_start"), "field", "value", "events", *["w"] * keep_window)
    )


def novelty_from_sightings(sightings: DataFrame) -> DataFrame:
    """New values per bin and field."""
    first = sightings.groupBy("field", "value").agg(F.min("bin_start").alias("bin_start"))
    return first.groupBy("bin_start", "field").agg(F.count("*").alias("new_values"))


class FirstSightings(StatefulProcessor):
    """Keeps the last bin of every (field, value) and passes on the bins in which it is new.

    Input are closed bins, which come in order: whatever was late has been counted in its bin before. With ``expiry``,
    a value unseen for longer is new again; a timer forgets it once every bin that could still have known it has closed.
    """

    SCHEMA = "field string, inside timestamp"  # what the counts need; a row costs Python by its columns

    def __init__(self, bin_size: int, expiry: int | None):
        self.bin_size, self.expiry = bin_size, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "bin_start long")

    def _until(self, last: int) -> int:
        """Milliseconds at which a value last seen in this bin is forgotten."""
        return 1000 * (last + self.expiry + self.bin_size)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.last.get()[0] if self.last.exists() else None
        last = known
        for row in sorted(rows, key=lambda r: r.bin_start):  # one row a bin that has closed since the last trigger
            if last is None or (self.expiry is not None and row.bin_start - last > self.expiry):
                yield Row(field=key[0], inside=row.inside)
            last = row.bin_start
        self.last.update((last,))
        if self.expiry is not None:
            if known is not None:
                self.handle.deleteTimer(self._until(known))
            self.handle.registerTimer(self._until(last))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def novelty(stream: DataFrame, bin_size: int, fields: dict[str, list[str]], delay: str = "1 hour", expiry: int | None = None) -> DataFrame:
    """New values per closed bin and field, as one stream.

    Three stateful steps: sightings per bin (open bins only), known values (keyed by field and value, in RocksDB), counts per
    bin. Without ``expiry`` the second one remembers every value; with it, in seconds, a value unseen for longer is new again.
    """
    seen = value_sightings(stream, bin_size, fields, delay, keep_window=True)
    first = seen.select("field", "value", "bin_start", (F.col("w.end") - F.expr("INTERVAL 1 MICROSECOND")).alias("inside"))
    new = first.groupBy("field", "value").transformWithState(
        FirstSightings(bin_size, expiry), FirstSightings.SCHEMA, "append", "EventTime", eventTimeColumnName="inside")
    return (
        new.groupBy(F.window("inside", f"{bin_size} seconds").alias("w"), "field").agg(F.count("*").alias("new_values"))
        .select(F.unix_seconds("w.start").alias("bin_start"), "field", "new_values")
    )


def dedup_edges(stream: DataFrame, bin_size: int, delay: str = "1 hour") -> DataFrame:
    """One row per (bin, source, destination), written when the bin has closed.

    Duplicates are dropped on the window itself, so the state lives until the watermark has passed
    the end of the bin, however long the bin is.
    """
    return (
        stream.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", f"{bin_size} seconds").alias("w"), "src_ip", "dest_ip").agg(F.count("*").alias("copies"))
        .select(F.unix_seconds("w.start").alias("bin_start"), "src_ip", "dest_ip", "copies")
    )


def redteam_labels(stream: DataFrame, redteam: DataFrame) -> DataFrame:
    """Label a stream of authentications against the static red-team list."""
    return label_redteam(stream, redteam)
