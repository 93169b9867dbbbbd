"""Streams of rows of frames: running counters, and batches handed to the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(stream: DataFrame, at: str, width: str = "30 days", late: str = "7 days") -> DataFrame:
    """(start, frame_id, n_rows): rows per frame and window of event time, late rows within the watermark included."""
    out = stream.withWatermark(at, late).groupBy(F.window(at, width), "frame_id").agg(F.count("*").alias("n_rows"))
    return out.select(F.col("window.start").alias("start"), "frame_id", "n_rows")


def written_counts(stream: DataFrame, out: str, checkpoint: str):
    """Run a stream of changing counts to the end of its input; each micro-batch writes the rows that changed under its own number."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The last state of every key of what written_counts() wrote."""
    rows = spark.read.parquet(out)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def distinct_rows(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """The stream without repeats of a key; keys older than the watermark are forgotten."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run a batch operator on every micro-batch and write its result under the batch's number, so a repeat overwrites itself."""

    def write(df: DataFrame, number: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
