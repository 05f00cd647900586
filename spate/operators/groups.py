"""Skew-safe building blocks used across the operators.

* ``first_per_group`` / ``last_per_group``: whole first/last row per key as a
  partial ``min_by``/``max_by`` aggregate (map-side combine), never a window
  that would sort a hot group inside one task.
* ``global_rank``: exact 1..n row numbers in a total order, computed with a
  range partitioning and per-partition offsets; no single-partition window.
* ``lookup_join``: many-to-one join against a dimension that may itself be
  large, with the hot keys of the fact side salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROW = "__row"
_KEY = "__ord"

# Bits used by monotonically_increasing_id() for the position inside a partition.
_PARTITION_SHIFT = 33


def _ordering(order) -> Column:
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return cols[0] if len(cols) == 1 else F.struct(*cols)


def first_per_group(df: DataFrame, keys, order, drop_null_keys: bool = False) -> DataFrame:
    """The whole row with the smallest ``order`` for each distinct ``keys``.

    ``order`` is a list of column names/expressions; make it unique (add the id)
    for a deterministic survivor.  Output keeps ``df``'s column order.
    """
    keys = list(keys)
    cols = df.columns
    others = [c for c in cols if c not in keys]
    src = df
    if drop_null_keys:
        for k in keys:
            src = src.filter(F.col(k).isNotNull())
    src = src.withColumn(_KEY, _ordering(order))
    agg = src.groupBy(*keys).agg(
        F.min_by(F.struct(*[F.col(c) for c in others]), F.col(_KEY)).alias(_ROW)
    )
    return agg.select(*[F.col(c) if c in keys else F.col(f"{_ROW}.{c}").alias(c) for c in cols])


def last_per_group(df: DataFrame, keys, order) -> DataFrame:
    """The whole row with the largest ``order`` for each distinct ``keys``."""
    keys = list(keys)
    cols = df.columns
    others = [c for c in cols if c not in keys]
    src = df.withColumn(_KEY, _ordering(order))
    agg = src.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in others]), F.col(_KEY)).alias(_ROW)
    )
    return agg.select(*[F.col(c) if c in keys else F.col(f"{_ROW}.{c}").alias(c) for c in cols])


def global_rank(df: DataFrame, order, rank_col: str = "rank", partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` = 1..n in the total order ``order`` (make it unique).

    Plan: range-partition and sort by ``order`` (a distributed sort), tag each
    row with ``monotonically_increasing_id`` (partition id in the high bits,
    position in the low bits), count rows per partition (a table with one row
    per partition — its size is bounded by the partition count), turn the
    counts into offsets and add them back with a broadcast join.  The tagged
    rows are written once to the checkpoint folder so that the counts and the
    positions come from the same partitioning.
    """
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (
        df.repartitionByRange(n, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__pid", F.shiftright(F.col("__mid"), _PARTITION_SHIFT))
    )
    # The tagged rows feed both the per-partition counts and the final join.
    # Range bounds come from a sample, so two recomputations could partition
    # differently; materialising once keeps positions and offsets consistent.
    from spate.session import cut_lineage

    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    # One row per partition: bounded by n, safe to broadcast.
    from pyspark.sql import Window

    offsets = counts.select(
        "__pid",
        (F.sum("__cnt").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"),
    ).fillna(0, subset=["__off"])
    pos = F.col("__mid").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return (
        tagged.join(F.broadcast(offsets), "__pid")
        .withColumn(rank_col, F.col("__off") + pos + 1)
        .drop("__mid", "__pid", "__off")
    )


def lookup_join(
    fact: DataFrame,
    dim: DataFrame,
    on: str,
    how: str = "inner",
    salts: int = 0,
) -> DataFrame:
    """Many-to-one join of ``fact`` with ``dim`` (unique on ``on``).

    With ``salts > 0`` the fact side gets a salt derived from its row content
    and the dimension is replicated ``salts`` times, so a key holding a third
    of the fact rows is spread over ``salts`` tasks.  AQE still converts the
    join to a broadcast when the materialised dimension is small, and splits
    remaining skewed partitions.
    """
    if salts <= 1:
        return fact.join(dim, on, how)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in fact.columns]), F.lit(salts))
    f = fact.withColumn("__salt", salt.cast("int"))
    d = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return f.join(d, [on, "__salt"], how).drop("__salt")


def paged_lists(df: DataFrame, keys, order, fields, size: int = 1000, name: str = "posts", salts: int = 16) -> DataFrame:
    """``(*keys, page, n, name)``: the rows of each key in ``order`` (make it unique), cut into pages 0, 1, ... of at
    most ``size`` rows; ``name`` is the page's array of structs of ``fields``, in order.  Rows with a null key are
    left out.

    Positions come from one distributed sort (``global_rank``), less the first position of the key, so a key that
    holds a third of all rows is sorted, joined (salted) and listed by many tasks, and no row holds more than a page.
    """
    keys = list(keys)
    src = df.dropna(subset=keys)
    ranked = global_rank(src, [*keys, *order], "__rank").withColumn("__key", F.struct(*keys))
    first = ranked.groupBy("__key").agg(F.min("__rank").alias("__first"))
    at = F.col("__rank") - F.col("__first")
    placed = lookup_join(ranked, first, "__key", salts=salts)
    placed = placed.select(*keys, F.floor(at / size).cast("long").alias("page"), F.struct(F.col("__rank"), *fields).alias("__row"))
    pages = placed.groupBy(*keys, "page").agg(F.sort_array(F.collect_list("__row")).alias(name))
    return pages.select(*keys, "page", F.size(name).cast("long").alias("n"), F.transform(name, lambda r: r.dropFields("__rank")).alias(name))


def with_computed(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add column ``name`` = ``expr``, evaluated exactly once per row.

    Predicate pushdown substitutes a projected alias into every filter above
    it, so a filter on an expensive expression (a whole-text cleaning) would
    evaluate it once per reference.  A one-element ``explode`` is a Generate
    node, which filters are not pushed through, so the value is computed once.
    """
    cols = [F.col(c) for c in df.columns if c != name]
    return df.select(*cols, F.explode(F.array(expr)).alias(name))
