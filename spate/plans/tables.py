"""Loading the driver's parquet tables and mapping them onto post-shaped frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over the cluster before CPU-heavy per-row work.

    A planning-time check: only when the scan yields fewer partitions than the
    cluster runs tasks at once (small inputs, or one large row group) are the
    rows redistributed round-robin.  A 100 TB scan has far more partitions than
    cores and is left untouched, so it pays no extra shuffle.
    """
    target = df.sparkSession.sparkContext.defaultParallelism * 2
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def documents_as_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as posts: ``id`` = doc_id (also the input order)."""
    return spread(
        table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    )


def events_as_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as timed posts: ``created_at`` = ts (cast to a UTC timestamp),
    ``user_id`` as is, ``event_type`` plays the location name."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        "user_id",
        F.col("event_type").alias("loc_name"),
        "value",
    )
