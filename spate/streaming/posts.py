"""Structured Streaming twins of two batch operators.

X1 ``dedup_stream``: first arrival of each post id wins (watermarked state).
X2 ``daily_counts_stream``: tumbling per-day post counts, emitted in append
mode once the watermark passes the end of the day.

Event time must be ``timestamp`` (``withWatermark`` rejects
``timestamp_ntz``), so zone-less times are first read as UTC.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.functions.times import utc_instant
from spate.session import ensure_checkpoint_dir


def _event_time(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(ts, utc_instant(df, ts))


def dedup_stream(df: DataFrame, id: str = "id", ts: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """Drop repeated post ids arriving within the watermark delay."""
    return _event_time(df, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark([id])


def daily_counts_stream(df: DataFrame, ts: str = "created_at", delay: str = "1 hour") -> DataFrame:
    """Per-day post counts (tumbling one-day windows)."""
    s = _event_time(df, ts).withWatermark(ts, delay)
    return s.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("day_start"), F.col("w.end").alias("day_end"), "n"
    )


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over everything available (``availableNow``) into
    a Parquet table under the checkpoint folder, then read it back as a batch
    DataFrame.  State and progress are checkpointed under ``name``: a job started
    again with the same name resumes instead of recomputing."""
    base = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    out, ckpt = os.path.join(base, "data"), os.path.join(base, "checkpoint")
    q = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", ckpt)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def read_stream_table(spark: SparkSession, directory: str, file_name: str, schema: T.StructType) -> DataFrame:
    """A file stream over one table's parquet files in ``directory``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file_name).parquet(directory)
