"""Spam limiting and last-wins merges.

A2 ``merge_pages``, A3 ``one_per_user_week``, A4 ``user_rollup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spate.operators.groups import first_per_group, last_per_group, paged_lists


def week_start(ts) -> Column:
    """Monday 00:00 of the calendar week (Mon–Sun) containing ``ts``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.date_trunc("week", c)


def week_label(ts) -> Column:
    """The week's Sunday as a date: a Mon 00:00 – Sun 23:59:59 bin labelled by
    its Sunday (decision D14)."""
    return F.date_add(F.to_date(week_start(ts)), 6)


def merge_pages(df: DataFrame, id: str = "id", seq: str = "seq") -> DataFrame:
    """A2: several fetched pages may hold the same post; the last (largest
    ``seq``) version of each id wins.  Partial ``max_by``, skew-safe."""
    return last_per_group(df, [id], [seq])


def one_per_user_week(
    df: DataFrame,
    user: str = "user_id",
    ts: str = "created_at",
    id: str = "id",
    loc: str | None = None,
) -> DataFrame:
    """A3: the first post (by ``ts``, then ``id``) of each user in each calendar
    week, optionally per location.  Rows with a null key are dropped (D1).
    Adds ``week``: the Sunday label of the bin."""
    keys = [user, "week"] + ([loc] if loc else [])
    src = df.withColumn("week", week_label(ts))
    return first_per_group(src, keys, [ts, id], drop_null_keys=True)


def user_rollup(df: DataFrame, user: str = "user_id", ts: str = "created_at", id: str = "id", loc: str = "loc_name") -> DataFrame:
    """A4: per user the first post id (by time, then id), the number of posts,
    first and last time and the number of distinct location names.

    The lists of a user's times, names and ids are ``user_posts``.
    """
    order = F.struct(F.col(ts), F.col(id))
    return df.filter(F.col(user).isNotNull()).groupBy(user).agg(
        F.min_by(F.col(id), order).alias("first_id"),
        F.count(F.lit(1)).alias("n_posts"),
        F.min(ts).alias("first_time"),
        F.max(ts).alias("last_time"),
        F.count_distinct(F.col(loc)).alias("n_locations"),
    )


def user_posts(df: DataFrame, user: str = "user_id", ts: str = "created_at", id: str = "id", loc: str = "loc_name", size: int = 1000) -> DataFrame:
    """A4: per user the times, location names and ids of the posts (by time, then id) in pages of at most ``size``:
    ``(user, page, n, posts array<struct<ts, id, loc>>)``, so a prolific account never becomes one huge row."""
    return paged_lists(df, [user], [ts, id], [ts, id, loc], size)
