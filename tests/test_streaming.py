"""X1 / X2 on a file stream with repeated ids across files."""

import datetime
import os
import tempfile

from pyspark.sql import types as T

from spate.streaming import posts as stream

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("created_at", T.TimestampNTZType()), T.StructField("text", T.StringType())]
)


def test_stream_dedup_and_daily_counts(spark):
    d = tempfile.mkdtemp(prefix="spate-stream-")
    ts = datetime.datetime
    a = [(1, ts(2024, 1, 1, 10), "a"), (2, ts(2024, 1, 1, 11), "b"), (3, ts(2024, 1, 2, 9), "c")]
    b = [(2, ts(2024, 1, 1, 11), "b again"), (4, ts(2024, 1, 3, 9), "d")]
    spark.createDataFrame(a, SCHEMA).coalesce(1).write.parquet(os.path.join(d, "p1"))
    spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(os.path.join(d, "p2"))
    src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(d)
    ded = stream.run_to_table(spark, stream.dedup_stream(src, id="id", ts="created_at", delay="1 day"), "t-dedup-" + os.path.basename(d))
    assert sorted(r["id"] for r in ded.collect()) == [1, 2, 3, 4]
    src2 = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(d)
    counts = stream.run_to_table(spark, stream.daily_counts_stream(src2, ts="created_at", delay="1 hour"), "t-daily-" + os.path.basename(d))
    got = {str(r["day_start"])[:10]: r["n"] for r in counts.collect()}
    # days whose end the watermark (latest time − 1 hour) has passed are emitted
    assert got == {"2024-01-01": 3, "2024-01-02": 1}


def test_zone_less_times_are_utc_in_any_session(spark):
    d = os.path.join(tempfile.mkdtemp(prefix="spate-stream-"), "p")
    rows = [(1, datetime.datetime(2024, 1, 1, 1), "a"), (2, datetime.datetime(2024, 1, 3, 1), "b")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(d)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        src = spark.readStream.schema(SCHEMA).parquet(d)
        out = stream.run_to_table(spark, stream.daily_counts_stream(src), "t-zone-" + os.path.basename(os.path.dirname(d)))
        assert [tuple(r) for r in out.selectExpr("unix_seconds(day_start)", "n").collect()] == [(1704067200, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
