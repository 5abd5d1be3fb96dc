"""Streaming forms of bounded rules: resume by key, gaps between keyframes, running label counts, record sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryframe.functions.columns import total


def resume_stream(frames: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once: a repeat within ``delay`` of the first is dropped, and state older than that goes."""
    return frames.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def gap_sessions(frames: DataFrame, scene: str, time: str, gap: str, delay: str) -> DataFrame:
    """Runs of keyframes of a scene without a gap of ``gap`` or more: their bounds and sizes."""
    grouped = frames.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), scene)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(scene, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_labels(frames: DataFrame, label: str, flag: str) -> DataFrame:
    """Label counts that grow with the stream; for complete or update mode."""
    return frames.groupBy(label).agg(F.count(F.lit(1)).alias("n"), total(F.col(flag)).alias("n_flag"))


def start_record_sinks(frames: DataFrame, reason: str, path: str, checkpoint: str) -> StreamingQuery:
    """Valid and quarantined rows of each micro-batch into two Parquet folders.

    A batch overwrites its own partition, so one that is run again after a failure writes the same files.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("batch", F.lit(batch_id))
        for name, part in (("valid", rows.where(F.col(reason).isNull())), ("quarantine", rows.where(F.col(reason).isNotNull()))):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/{name}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
