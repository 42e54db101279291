"""Event-time windows over a stream of events.

A stream is a folder that files arrive in.  ``run_to_table`` reads what is new, up to now, and
stops; the next run goes on where it stopped.  State and progress are kept in the checkpoint
folder, which has to be shared.  A window is written once, when the watermark (the latest event
time seen, less the delay) has passed its end; rows behind the watermark come too late and are
left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(
    spark: SparkSession, folder: str, schema: StructType | str = EVENTS, files_at_once: int | None = None, pattern: str = "*"
) -> DataFrame:
    """The events of the files of a folder; event time is cast before anything else is done with it."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def _summed(events: DataFrame, window, keys: tuple[str, ...], delay: str) -> DataFrame:
    return (
        events.withWatermark("ts", delay)
        .groupBy(window.alias("_window"), *keys)
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select(F.col("_window.start").alias("window_start"), F.col("_window.end").alias("window_end"), *keys, "events", "value")
    )


def tumbling(events: DataFrame, size: str, keys: tuple[str, ...] = ("event_type",), delay: str = "1 hour") -> DataFrame:
    """Events and their value per window of ``size``; windows follow each other."""
    return _summed(events, F.window("ts", size), keys, delay)


def sliding(events: DataFrame, size: str, slide: str, keys: tuple[str, ...] = ("event_type",), delay: str = "1 hour") -> DataFrame:
    """A window of ``size`` starts every ``slide``; an event is in each one that covers it."""
    return _summed(events, F.window("ts", size, slide), keys, delay)


def sessions(events: DataFrame, gap: str, keys: tuple[str, ...] = ("user_id",), delay: str = "1 hour") -> DataFrame:
    """Events of the same keys that are less than ``gap`` apart are one session, which ends ``gap``
    after its last event."""
    return _summed(events, F.session_window("ts", gap), keys, delay)


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write the windows that are closed by what there is to read now, and stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
