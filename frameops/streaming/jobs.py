"""Structured Streaming jobs (Q01-Q03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from frameops.operators.policy import rule_router


def route_batch(frames: DataFrame, face_size: float, blur: float) -> tuple[DataFrame, DataFrame]:
    """(routed, rejected) rows of one micro-batch; rows without signals are rejected."""
    usable = F.col("face_size_px").isNotNull() & F.col("blur_score").isNotNull()
    routed = rule_router(frames.filter(usable), face_size, blur)
    rejected = frames.filter(~usable).withColumn("reason", F.lit("missing_signal"))
    return routed, rejected


def stream_route(frames: DataFrame, output: str, failures: str, checkpoint: str, face_size: float = 120, blur: float = 350) -> StreamingQuery:
    """Q01: stateless routing of arriving frames, unusable frames to a side folder.

    Each batch writes into its own subfolder, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        for part, path in zip(route_batch(batch, face_size, blur), (output, failures), strict=True):
            part.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return frames.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def method_mix(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Q02: tumbling or sliding counts and failure rate per method; rows behind the watermark are dropped.

    ``events``: ts, method, failed.  Works on a stream and on a static table.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(window, "method").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("failed").cast("double")).alias("failure_rate"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "method", "n", "failure_rate")


def stream_method_mix(events: DataFrame, output: str, checkpoint: str, **options) -> StreamingQuery:
    """Q02 as a stream: windows are written once, after the watermark has passed them."""
    rows = method_mix(events, **options)
    return rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_resume(work: DataFrame, output: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Q03: each (path, method) once, however often it arrives within the watermark."""
    once = work.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["relative_path", "method"])
    return once.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = 2) -> DataFrame:
    """Parquet folder as a stream; None: all files that are there in one batch."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)
