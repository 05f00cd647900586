"""Times without a zone, read as UTC whatever the session's time zone is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def utc_instant(df: DataFrame, ts: str) -> Column:
    """``ts`` as ``timestamp``: zone-less times are UTC, others stay as they are."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return F.concat(F.col(ts).cast("string"), F.lit("Z")).cast("timestamp")
    return F.col(ts).cast("timestamp")
