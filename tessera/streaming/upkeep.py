"""Streaming upkeep on Structured Streaming: state tables kept by micro-batches, watermarked counts, deduplicated logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators import projections
from tessera.sources import segments


def keep_latest(stream: DataFrame, path: str, key: Sequence[str], order: Sequence[str]) -> DataStreamWriter:
    """Keeps a table of the last row of each key, read by latest_state(), in sorted segments: a batch adds one with the keys that it touches, and segments are
    merged and old ones deleted as they grow. A batch that runs again writes the same, and readers see a batch whole or not at all."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: segments.upsert(batch.sparkSession, path, epoch, batch, key, order))


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The table that keep_latest() keeps."""
    return segments.live(spark, path, "rows")


def keep_projections(stream: DataFrame, path: str, key: Sequence[str], views: Mapping[str, projections.View], revised: Sequence[str] = ()) -> DataStreamWriter:
    """Keeps projections of a stream of changes (projections.apply)."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: projections.apply(batch.sparkSession, path, epoch, batch, key, views, revised))


def stale_subjects(stream: DataFrame, dependencies: DataFrame, depends_on: str, subject: str, path: str) -> DataStreamWriter:
    """Appends, for each batch of changes, the subjects that depend on them."""
    def write(batch: DataFrame, epoch: int) -> None:
        hit = dependencies.join(batch.select(depends_on).distinct(), depends_on, "left_semi").select(subject).distinct()
        hit.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write)


def windowed_counts(stream: DataFrame, time: str, key: Sequence[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size).alias("window"), *key).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, time: str, key: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(key))
