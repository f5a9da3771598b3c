"""Incremental runs as streams that end: new files alone are read, state and progress live in the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the JSON-lines files of a folder, each read once."""
    return spark.readStream.schema(schema).json(path)


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> int:
    """Handles what has arrived since the last run and stops; returns the batches handled.

    A run that was killed goes on at the batch it had begun, so a sink must be able to see a batch number twice.
    """
    seen = []

    def each(df: DataFrame, number: int) -> None:
        sink(df, number)
        seen.append(number)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return len(seen)


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch to a folder of its own number: a batch seen twice replaces itself."""

    def sink(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return sink


def once_by_id(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each id within the watermark: content-addressed jobs run once."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def event_windows(stream: DataFrame, time: str, width: str, delay: str, group: str) -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), group).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), group, "n")


def merge_members(stored: DataFrame, arrived: DataFrame) -> DataFrame:
    """Spans rebuilt from stored and late members; a span keeps its first id until it is closed."""
    both = stored.select("span_key", "member").unionByName(arrived.select("span_key", "member")).distinct()
    return both.groupBy("span_key").agg(F.count("*").alias("members"), F.min("member").alias("first_member"), (F.max("member") - F.min("member") + 1 == F.count("*")).alias("complete"))
