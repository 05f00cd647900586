"""J8, candidate mode: near duplicates by hash tables of random projections.

A row's code in a table is the signs of its products with ``bits`` random
directions.  Rows are looked up under their own code and under the codes that
differ in one bit.  Two rows of cosine s agree in a bit with probability
p = 1 - acos(s) / pi, so a table finds their pair with probability
p^b + b p^(b-1) (1 - p); ``lsh_plan`` picks the bits by cost and then as many
tables as the wished recall at the threshold needs.  Every candidate is checked
on the exact cosine: nothing is reported that the exact mode would not report.

Skew: equal vectors are collapsed to their earliest row first (a partial
aggregate).  Then every row is compared with the earliest row of its buckets,
one row a bucket, which already drops the bulk of a large group of near copies.
Only rows that are left are looked up everywhere, and the rows of a bucket meet
in bounded tiles, so a crowded bucket is spread over many tasks and none of its
rows is passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spate.operators.similarity import as_double_array, later_like_earlier, norm, own_vectors, similar_pairs, tile_cogroups
from spate.session import cut_lineage, release

#: Cost of sending one row to a bucket, in comparisons of two rows in a tile.
SEND = 200
MOST_BITS = 30
#: Copies of the rows that are sent in one turn, if one table does not need more.
MOST_COPIES = 16
#: So many counts of buckets are sent to every task (some 30 bytes each).
MOST_CELLS = 1 << 18


@dataclass(frozen=True)
class LshPlan:
    bits: int
    tables: int
    seed: int

    def directions(self, d: int) -> np.ndarray:
        """d x (tables * bits) random normal numbers."""
        return np.random.default_rng(self.seed).normal(size=(d, self.tables * self.bits))


def lsh_plan(rows: int, thr: float, recall: float = 0.95, seed: int = 1) -> LshPlan:
    """Bits and tables of least expected cost that find a pair of cosine ``thr`` with probability ``recall``."""
    p = 1 - math.acos(thr) / math.pi
    best = None
    for b in range(1, MOST_BITS + 1):
        found = p**b + b * p ** (b - 1) * (1 - p)
        tables = max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(found, 1 - 1e-12))))
        cost = tables * (1 + b) * (SEND + rows / 2**b)
        if best is None or cost < best[0]:
            best = cost, LshPlan(b, tables, seed)
    return best[1]


def _codes(rows: DataFrame, plan: LshPlan, d: int, probes: bool, tables: range | None = None) -> DataFrame:
    """``rows`` (id, ord, v, n) once per table (and, as probes, per neighbouring code): __bx the table, __by the code."""
    tables = range(plan.tables) if tables is None else tables
    matrix = rows.sparkSession.sparkContext.broadcast(plan.directions(d))  # d x tables x bits numbers
    schema = f"__id long, __o long, __vec {rows.schema['v'].dataType.simpleString()}, __nrm double, __bx int, __by long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            sign = ((v @ matrix.value).reshape(len(v), plan.tables, plan.bits) >= 0).astype(np.int64)
            own = sign @ (1 << np.arange(plan.bits, dtype=np.int64))
            flips = np.concatenate(([0], 1 << np.arange(plan.bits if probes else 0, dtype=np.int64)))
            for t in tables:
                code = (own[:, t, None] ^ flips[None, :]).ravel()
                at = pa.array(np.repeat(np.arange(len(v)), len(flips)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(at) for i in range(4)), pa.array(np.full(len(code), t, dtype=np.int32)), pa.array(code)],
                    names=["__id", "__o", "__vec", "__nrm", "__bx", "__by"],
                )

    return rows.select("id", "ord", "v", "n").mapInArrow(run, schema)


def _usable(df: DataFrame, vec: str, order: str, id: str) -> tuple[DataFrame, int]:
    """(id, ord, v, n) of the rows whose vector has a direction, and the vectors' length."""
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(order).cast("long").alias("ord"), own_vectors(df, vec).alias("v"))
    rows = rows.withColumn("n", norm(as_double_array("v"))).filter("n > 0 and not isnan(n)")
    sizes = rows.select(F.min(F.size("v")), F.max(F.size("v"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors have between {sizes[0]} and {sizes[1]} entries")
    return rows, sizes[0] or 0


def _cosines(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    """Cosines of the vectors in columns a and b, norms in the columns after them."""
    x, y = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64) for i in (a, b))
    return np.einsum("ij,ij->i", x, y) / (batch.column(a + 1).to_numpy() * batch.column(b + 1).to_numpy())


def _like_first(asked: DataFrame, index: DataFrame, thr: float) -> DataFrame:
    """Ids of the rows ``asked`` that are similar to the earliest row of one of their buckets in ``index``."""
    first = index.groupBy("__bx", "__by").agg(
        F.min("__o").alias("fo"), F.min_by(F.struct("__vec", "__nrm"), "__o").alias("f")
    ).select("__bx", "__by", "fo", F.col("f.__vec").alias("fv"), F.col("f.__nrm").alias("fn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(_cosines(batch, 1, 3) > thr))], names=["__id"])

    pairs = asked.join(first, ["__bx", "__by"]).filter("__o > fo").select("__id", "__vec", "__nrm", "fv", "fn")
    return pairs.mapInArrow(run, "__id long").distinct()


def _dropped(leaders: DataFrame, plan: LshPlan, d: int, thr: float) -> DataFrame:
    """(__id): the leaders with an earlier one of cosine > ``thr`` among their candidates.

    The tables are taken a few at a time, so that the disk holds few copies of the rows, and what one turn has dropped
    is asked no more.  First against the earliest row of the own bucket, then against all rows of all probed buckets."""
    gone = leaders.select(F.col("id").alias("__id")).limit(0)

    def turn(tables: range, probes: bool, found) -> None:
        nonlocal gone
        left = leaders.join(gone, leaders["id"] == gone["__id"], "left_anti")
        index = _codes(leaders, plan, d, False, tables)
        before, gone = gone, cut_lineage(gone.unionByName(found(_codes(left, plan, d, probes, tables), index).distinct()))
        release(before)

    gone = cut_lineage(gone)
    for tables in _turns(plan.tables, MOST_COPIES // 2):
        turn(tables, False, lambda asked, index: _like_first(asked, index, thr))
    for tables in _turns(plan.tables, MOST_COPIES // (2 + plan.bits)):
        turn(tables, True, lambda asked, index: tile_cogroups(asked, index, few=len(tables) << plan.bits <= MOST_CELLS).applyInPandas(
            lambda p, e: later_like_earlier(p, e, thr), schema="__id long"
        ))
    return gone


def _turns(tables: int, at_once: int) -> list[range]:
    """The numbers of the tables, ``at_once`` (1 at least) in each turn."""
    step = max(at_once, 1)
    return [range(k, min(k + step, tables)) for k in range(0, tables, step)]


def drop_near_duplicates_lsh(
    df: DataFrame, vec: str = "embedding", order: str = "ord", id: str = "id", thr: float = 0.8, recall: float = 0.95, seed: int = 1
) -> DataFrame:
    """J8 (candidates): the rows of ``df`` without an earlier row of cosine > ``thr`` among their candidates.

    Rows with a null, zero or NaN vector have no direction and stay; a null order is no order and stays.
    All other vectors must have the same length.
    """
    rows, d = _usable(df.filter(F.col(order).isNotNull() & F.col(id).isNotNull()), vec, order, id)
    first = rows.groupBy("v").agg(F.min_by("id", F.struct("ord", "id")).alias("id"), F.min("ord").alias("ord"), F.min("n").alias("n"))
    leaders = cut_lineage(first.select("id", "ord", "v", "n"))
    # Of equal vectors only the rows of the earliest order have no earlier copy.
    copies = rows.join(first.select("v", F.col("ord").alias("fo")), "v").filter("ord > fo").select("id")
    plan = lsh_plan(leaders.count(), thr, recall, seed)
    out = _dropped(leaders, plan, d, thr).select(F.col("__id").alias("id"))
    # Rows that share a dropped leader's vector and order go with it.
    same = rows.join(leaders.join(out, "id", "left_semi").select("v"), "v", "left_semi").select("id")
    dropped = same.unionByName(copies).distinct().withColumnRenamed("id", "__gone")
    return df.join(dropped, F.col(id).cast("long") == F.col("__gone"), "left_anti")


def similar_rows_lsh(
    queries: DataFrame, df: DataFrame, vec: str = "embedding", id: str = "id", thr: float = 0.8, recall: float = 0.95, seed: int = 1
) -> DataFrame:
    """(query, id, cosine): per query row the other rows of cosine > ``thr`` among its candidates."""
    rows, d = _usable(df, vec, id, id)
    asked, dq = _usable(queries, vec, id, id)
    rows = cut_lineage(rows)
    plan = lsh_plan(rows.count(), thr, recall, seed)

    if dq != d and dq:
        raise ValueError(f"query vectors have {dq} entries, rows {d}")
    pairs = tile_cogroups(_codes(asked, plan, d, probes=True), _codes(rows, plan, d, probes=False)).applyInPandas(
        lambda p, e: similar_pairs(p, e, thr), schema="query long, id long, cosine double"
    )
    return pairs.groupBy("query", "id").agg(F.max("cosine").alias("cosine"))
