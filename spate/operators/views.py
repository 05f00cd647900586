"""Analyst views over a selection of posts.

A5 ``value_counts``, A7 ``time_histogram``, A8 ``label_series``, A9 ``summary``,
A10 ``location_counts``, K1 ``page``, K2 ``sort_table``, K3 ``nearest``,
K4 ``hardest``, J6 ``split_selection``, J9 ``at_point``, F14 ``flag_selected``,
U1 ``union_labelled``, U2 ``intersect_ids``, U3 ``select_posts``, F5, F6, F11.

A selection is a DataFrame of post ids; membership is a semi/anti join, never
a driver-side id list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spate.functions.times import utc_instant
from spate.operators.groups import global_rank, paged_lists

# Pages up to this depth are served by a top-k (TakeOrderedAndProject); deeper
# pages go through an exact distributed rank.
TOPK_PAGE_LIMIT = 10_000


# ---------------------------------------------------------------------------
# Selections
# ---------------------------------------------------------------------------


def split_selection(df: DataFrame, ids: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(selected, not selected) by an id DataFrame; the two parts partition
    ``df``."""
    keys = ids.select(F.col(id)).distinct()
    return df.join(keys, id, "left_semi"), df.join(keys, id, "left_anti")


def flag_selected(df: DataFrame, ids: DataFrame, id: str = "id", flag: str = "selected") -> DataFrame:
    """add a boolean membership flag (real membership by id, D7)."""
    keys = ids.select(F.col(id), F.lit(True).alias(flag)).distinct()
    return df.join(keys, id, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def intersect_ids(*selections: DataFrame, id: str = "id") -> DataFrame:
    """Ids present in every selection."""
    sets = [s.select(id).distinct() for s in selections]
    return reduce(lambda a, b: a.join(b, id, "left_semi"), sets)


def union_labelled(dfs, label: str, id: str = "id", text: str = "text") -> DataFrame:
    """Stack labelled sets; each must carry ``label`` (else an error); the
    label column is renamed ``label``; duplicates are kept."""
    parts = []
    for i, d in enumerate(dfs):
        if label not in d.columns:
            raise ValueError(f"{label} label doesn't exist in data set {i}")
        parts.append(d.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(label).alias("label")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def complete_labels(df: DataFrame, cols) -> DataFrame:
    """drop rows where any annotation column is null or blank."""
    cond = reduce(
        lambda a, b: a & b,
        [F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "") for c in cols],
    )
    return df.filter(cond)


def slice_posts(df: DataFrame, start=None, end=None, ts: str = "created_at", **flags) -> DataFrame:
    """time range with both ends inclusive, plus equality on label flags."""
    out = df
    if start is not None:
        out = out.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        out = out.filter(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    for k, v in flags.items():
        out = out.filter(F.col(k) == F.lit(v))
    return out


def project(df: DataFrame, cols) -> DataFrame:
    """the result-table projection."""
    return df.select(*cols)


# ---------------------------------------------------------------------------
# Counts and summaries
# ---------------------------------------------------------------------------


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """A5: ``(col, count)`` of non-null values, most frequent first."""
    return (
        df.filter(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col(col))
    )


def location_counts(df: DataFrame, loc: str = "loc_name", top: int = 5) -> DataFrame:
    """A10: per location the post count, the label ``name (n)``, its rank
    (count desc, name) and whether it is among the first ``top``."""
    counts = df.filter(F.col(loc).isNotNull()).groupBy(loc).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(counts, [F.col("n").desc(), F.col(loc)], rank_col="rank")
    return ranked.select(
        loc,
        "n",
        F.concat(F.col(loc), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"),
        "rank",
        (F.col("rank") <= top).alias("is_top"),
    )


def summary(
    all_posts: DataFrame,
    located: DataFrame,
    selected: DataFrame,
    ts: str = "created_at",
    loc: str = "loc_name",
) -> DataFrame:
    """One row: total posts, posts with a location, selected posts, first
    and last selected time, distinct locations in total (a null name counts as
    one value) and in the selection (nulls not counted)."""
    # Single-row global aggregates combined as scalar subqueries (no join).
    total = all_posts.select(F.count(F.lit(1))).scalar()
    with_location = located.select(F.count(F.lit(1))).scalar()
    total_locations = located.select(
        F.count_distinct(F.col(loc)) + F.coalesce(F.max(F.col(loc).isNull().cast("int")), F.lit(0))
    ).scalar()
    return selected.agg(
        F.count(F.lit(1)).alias("selected"),
        F.min(ts).alias("first_time"),
        F.max(ts).alias("last_time"),
        F.count_distinct(F.col(loc)).alias("selected_locations"),
    ).select(
        total.alias("total"),
        with_location.alias("with_location"),
        "selected",
        "first_time",
        "last_time",
        total_locations.alias("total_locations"),
        "selected_locations",
    )


def _day(ts) -> Column:
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts)


def span_days(df: DataFrame, ts: str = "created_at") -> Column:
    """Whole days between the first and last time of ``df`` (a scalar Column)."""
    ends = df.agg(F.max(ts).alias("hi"), F.min(ts).alias("lo"))
    micros = F.unix_micros(utc_instant(ends, "hi")) - F.unix_micros(utc_instant(ends, "lo"))
    return ends.select(F.floor(micros / F.lit(86_400_000_000)).cast("long")).scalar()


def time_histogram(
    df: DataFrame,
    selection: DataFrame,
    ts: str = "created_at",
    id: str = "id",
    month_after_days: int = 30,
) -> DataFrame:
    """Bar counts for the selected and the not-selected posts.

    Bars are days when the **whole** table spans fewer than ``month_after_days``
    whole days, else calendar months labelled by their last day.  Inside each
    series' own first..last bar, empty bars appear with 0.
    Output ``(series, bin date, n)``.
    """
    monthly = span_days(df, ts) >= month_after_days
    flagged = flag_selected(df.select(id, ts), selection, id=id)
    day = _day(ts)
    bin_expr = F.when(monthly, F.last_day(day)).otherwise(day)
    counts = flagged.filter(F.col(ts).isNotNull()).select(
        F.when(F.col("selected"), F.lit("selected")).otherwise(F.lit("not_selected")).alias("series"),
        bin_expr.alias("bin"),
    ).groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"))
    # One row per series: the spine of bars between its first and last bar.
    bounds = counts.groupBy("series").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    day_spine = F.sequence(F.col("lo"), F.col("hi"), F.expr("INTERVAL 1 DAY"))
    month_spine = F.transform(
        F.sequence(F.trunc("lo", "MM"), F.trunc("hi", "MM"), F.expr("INTERVAL 1 MONTH")),
        lambda d: F.last_day(d),
    )
    spine = bounds.select("series", F.explode(F.when(monthly, month_spine).otherwise(day_spine)).alias("bin"))
    return (
        spine.join(counts, ["series", "bin"], "left")
        .select("series", "bin", F.coalesce(F.col("n"), F.lit(0)).alias("n"))
        .orderBy("series", "bin")
    )


def histogram_posts(
    df: DataFrame,
    selection: DataFrame,
    ts: str = "created_at",
    id: str = "id",
    month_after_days: int = 30,
    size: int = 1000,
) -> DataFrame:
    """The ids behind the bars of ``time_histogram``, ascending, in pages of at most ``size``:
    ``(series, bin, page, n, posts array<struct<id>>)``; empty bars have no page."""
    flagged = flag_selected(df.select(id, ts), selection, id=id).filter(F.col(ts).isNotNull())
    rows = flagged.select(
        F.when(F.col("selected"), F.lit("selected")).otherwise(F.lit("not_selected")).alias("series"),
        F.when(span_days(df, ts) >= month_after_days, F.last_day(_day(ts))).otherwise(_day(ts)).alias("bin"),
        F.col(id),
    )
    return paged_lists(rows, ["series", "bin"], [id], [id], size)


def select_by_bins(df: DataFrame, bins: DataFrame, whole: DataFrame | None = None, ts: str = "created_at") -> DataFrame:
    """Posts falling in chosen histogram bars (``bins`` has a ``bin`` date
    column) — the drill-down of A7 as a semi join, no id lists."""
    whole = df if whole is None else whole
    monthly = span_days(whole, ts) >= 30
    day = _day(ts)
    keyed = df.withColumn("__bin", F.when(monthly, F.last_day(day)).otherwise(day))
    return keyed.join(bins.select(F.col("bin").alias("__bin")).distinct(), "__bin", "left_semi").drop("__bin")


def label_series(df: DataFrame, cols, ts: str = "created_at", freq: str = "week") -> DataFrame:
    """Per week (Sunday label) or day the sums of 0/1 label columns, every
    bin between the first and last present (empty ones as 0), sorted."""
    if freq == "week":
        b = F.date_add(F.to_date(F.date_trunc("week", F.col(ts))), 6)
        step = F.expr("INTERVAL 7 DAY")
    elif freq == "day":
        b = _day(ts)
        step = F.expr("INTERVAL 1 DAY")
    else:
        raise ValueError(f"unknown frequency {freq}")
    sums = df.filter(F.col(ts).isNotNull()).groupBy(b.alias("bin")).agg(
        *[F.sum(F.col(c)).alias(c) for c in cols]
    )
    bounds = sums.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi", step)).alias("bin"))
    return (
        spine.join(sums, "bin", "left")
        .select("bin", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])
        .orderBy("bin")
    )


def fetch_bin(series: DataFrame, when) -> DataFrame:
    """A8 helper: the row of one bin."""
    return series.filter(F.col("bin") == F.lit(when).cast("date"))


# ---------------------------------------------------------------------------
# Sorting, paging, nearest
# ---------------------------------------------------------------------------


def round_doubles(df: DataFrame, digits: int = 3) -> DataFrame:
    return df.select(
        *[
            F.round(F.col(f.name), digits).alias(f.name)
            if f.dataType.typeName() in ("double", "float")
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _ordered(sort: str | None, desc: bool, id: str) -> list[Column]:
    cols = []
    if sort:
        cols.append(F.col(sort).desc_nulls_last() if desc else F.col(sort).asc_nulls_last())
    cols.append(F.col(id).asc())
    return cols


def page(df: DataFrame, sort: str | None = None, desc: bool = False, page_no: int = 0, size: int = 20, id: str = "id", digits: int = 3) -> DataFrame:
    """K1: doubles rounded to ``digits``, optional one-column sort (ties broken
    by id so pages are stable), page ``page_no`` of ``size`` rows."""
    out = round_doubles(df, digits)
    order = _ordered(sort, desc, id)
    start = page_no * size
    if start + size <= TOPK_PAGE_LIMIT:
        return out.orderBy(*order).offset(start).limit(size)
    ranked = global_rank(out, order, rank_col="__rank")
    return ranked.filter((F.col("__rank") > start) & (F.col("__rank") <= start + size)).orderBy("__rank").drop("__rank")


def sort_table(df: DataFrame, col: str, desc: bool = False) -> DataFrame:
    """K2: sort a result table by any column."""
    return df.orderBy(F.col(col).desc() if desc else F.col(col).asc())


def with_distance(df: DataFrame, lon: float, lat: float, lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    return df.withColumn(
        "distance",
        (F.col(lon_col) - F.lit(lon)) * (F.col(lon_col) - F.lit(lon))
        + (F.col(lat_col) - F.lit(lat)) * (F.col(lat_col) - F.lit(lat)),
    )


def nearest(df: DataFrame, lon: float, lat: float, k: int, id: str = "id", lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """K3: the ``k`` posts closest to (lon, lat) by squared degree distance
    (ties by id).  Small k is a top-k; large k an exact distributed rank."""
    d = with_distance(df.filter(F.col(lon_col).isNotNull() & F.col(lat_col).isNotNull()), lon, lat, lon_col, lat_col)
    if k <= TOPK_PAGE_LIMIT:
        return d.orderBy(F.col("distance"), F.col(id)).limit(k)
    ranked = global_rank(d, [F.col("distance"), F.col(id)], rank_col="__rank")
    return ranked.filter(F.col("__rank") <= k).orderBy("__rank").drop("__rank")


def at_point(df: DataFrame, lon: float, lat: float, lon_col: str = "lon", lat_col: str = "lat") -> DataFrame:
    """Posts exactly at a marker coordinate."""
    return df.filter((F.col(lon_col) == F.lit(lon)) & (F.col(lat_col) == F.lit(lat)))


def hardest(df: DataFrame, score: str = "loss", n: int = 100, label: str | None = "label", positive=1, id: str = "id") -> DataFrame:
    """K4: the ``n`` rows with the highest ``score`` (optionally positives only); ties by id."""
    out = df.filter(F.col(label) == F.lit(positive)) if label else df
    return out.orderBy(F.col(score).desc(), F.col(id)).limit(n)


def select_posts(df: DataFrame, spec: dict | None, id: str = "id", ts: str = "created_at") -> DataFrame:
    """Choose the selection by priority — reset > histogram bars > explicit
    ids (scatter) > map cluster (nearest k or exact point) > region > all."""
    spec = spec or {}
    if spec.get("reset"):
        return df
    if spec.get("bins") is not None:
        return select_by_bins(df, spec["bins"], whole=df, ts=ts)
    if spec.get("ids") is not None:
        return split_selection(df, spec["ids"], id=id)[0]
    if spec.get("cluster") is not None:
        c = spec["cluster"]
        if c.get("size", 1) > 1:
            return nearest(df, c["lon"], c["lat"], c["size"], id=id).drop("distance")
        return at_point(df, c["lon"], c["lat"])
    if spec.get("region") is not None:
        from spate.operators.geo import filter_region

        return filter_region(df, spec["regions"], spec["region"])
    return df
