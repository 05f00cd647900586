"""Embedding whitening with Spark MLlib's BlockMatrix.

An entry c becomes x = floor(64 c) + 1000000.  The fit list is each different x
vector once.

1. The fit list is written once with dense row numbers; its size n and the sums S
   per dimension are exact integers.
2. Rows are centred, (n x - S) / n from exact integers, and dealt into the blocks
   of an IndexedRowMatrix and then a BlockMatrix.
3. Transpose times itself is the scatter.  The long dimension is split, so that a
   task meets ``BLOCKS`` blocks, and the partial products (d x d) are added up.
4. ``numpy.linalg.eigh`` of the scatter / n on the driver: d x d numbers, whatever
   the rows.  The whitening matrix has the first ``k`` eigenvectors, each over the
   root of its eigenvalue; the sign is such that its largest entry is positive.
5. All rows, copies too, form a second BlockMatrix; its product with the whitening
   matrix has their coordinates, which go back to the ids by row number.  The same
   product of the fit list, times its own transpose, tells how far its covariance
   is from the identity.

Rows are left out when their vector is null or empty, holds null, NaN or infinity,
or has another length than most (on equal counts the larger length; entries beyond
2^46 count as infinite, their x has no exact double).  Components whose eigenvalue
is not above 1e-12 of the largest are left out: nothing can be scaled to 1 along
them, and a table without any (one different vector, or none) gives no rows.  Null
and repeated ids are rows like others.  ``deviation`` is null where it passes 64
bits.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.llm.common import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows and columns of a block, and blocks of rows that one task of a product holds.
BLOCK_ROWS, BLOCK_COLS, BLOCKS = 1_024, 1_024, 8
LARGEST = float(1 << 46)
LEAST_EIGENVALUE = 1e-12
_PARTITION_SHIFT = 33


@dataclass
class Whitening:
    """The fitted transformation; all of it is of size d or d x k."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float


def integer_rows(df: DataFrame, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(id, x) of the rows that can be used, x as integers."""
    v = F.transform(F.col(vec), lambda e: e.cast("double"))
    rows = df.select(F.col(id).alias("id"), v.alias("v")).filter("v is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST)))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size("v") == d).select("id", F.transform("v", lambda e: F.floor(e * SCALE).cast("long") + SHIFT).alias("x"))


def numbered(df: DataFrame, name: str, rows: int) -> tuple[DataFrame, int]:
    """``df`` written once, with ``row`` = 0, 1, ... and its number of rows.

    Row numbers follow from the files as written, so a task that runs again deals the same ones.
    """
    parts = max(1, -(-rows // (BLOCK_ROWS * BLOCKS)))
    df = stage(df.repartition(parts).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", _PARTITION_SHIFT).cast("int")
    sizes = {r["p"]: r["c"] for r in df.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()}  # one row a partition
    first, begin = 0, []
    for p in range(parts):
        begin.append(first)
        first += sizes.get(p, 0)
    offset = F.element_at(F.lit(begin), part + 1)
    row = offset + F.col("at").bitwiseAND(F.lit((1 << _PARTITION_SHIFT) - 1))
    return df.withColumn("row", row.cast("long")).drop("at"), first


def sums_of(fit: DataFrame) -> list[int]:
    """Exact sums per dimension; a task sends d numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                part = x.sum(axis=0, dtype=object) if _large(x, len(x)) else x.sum(axis=0)
                part = np.array([int(v) for v in part], dtype=object)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(total)), pa.int32()), "s": pa.array([str(v) for v in total])})

    part = fit.select("x").mapInArrow(run, "dim int, s string")
    got = part.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return [int(r["s"]) for r in got]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _large(x: np.ndarray, factor: int) -> bool:
    return bool(x.size) and max(abs(int(x.max())), abs(int(x.min()))) * max(factor, 1) >= 1 << 62


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where that is enough, else in Python's integers."""
    mid = [s // n for s in sums]
    if max(abs(m) for m in mid) >= 1 << 61 or _large(x, 2):
        return n * x.astype(object) - np.array(sums, dtype=object)
    near = x - np.array(mid, dtype=np.int64)
    rest = [s - n * m for s, m in zip(sums, mid)]
    if _large(near, 2 * n):
        return n * near.astype(object) - np.array(rest, dtype=object)
    return n * near - np.array(rest, dtype=np.int64)


def centred(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """(row, centred, and whatever else the rows carry but x, deviation)."""
    keep = [f for f in rows.schema.fields if f.name != "x"]
    schema = T.StructType([*keep, T.StructField("centred", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())])
    d = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dev = deviations(_matrix(batch.column("x")), n, sums)
            value = (dev / n).astype(np.float64)
            exact = dev.dtype != object and (not dev.size or d * int(np.abs(dev).max()) ** 2 < 1 << 63)
            square = (dev * dev if exact else dev.astype(object) ** 2).sum(axis=1)
            square = [int(s) if s < 1 << 63 else None for s in square]
            offsets = pa.array(np.arange(0, d * (len(value) + 1), d, dtype=np.int32))
            arrays = [*(batch.column(f.name) for f in keep), pa.ListArray.from_arrays(offsets, pa.array(value.ravel())), pa.array(square, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Rows (row, centred) as distributed blocks."""
    from pyspark.ml.functions import array_to_vector

    vectors = MLUtils.convertVectorColumnsFromML(rows.select(F.col("row").alias("index"), array_to_vector("centred").alias("vector")), "vector")
    indexed = IndexedRowMatrix(callMLlibFunc("createIndexedRowMatrix", vectors, n, d))
    return indexed.toBlockMatrix(BLOCK_ROWS, min(d, BLOCK_COLS))


def transposed_product(a: BlockMatrix) -> np.ndarray:
    """a' a as a local matrix; the long dimension is split so that a task holds BLOCKS blocks."""
    splits = max(1, -(-a.numRows() // (BLOCK_ROWS * BLOCKS)))
    t = a.transpose()
    java = t._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, t.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def times(a: BlockMatrix, matrix: np.ndarray) -> BlockMatrix:
    """Product with a small matrix (d x k), which every task gets."""
    rows = a.colsPerBlock
    sc = SparkSession.active().sparkContext
    parts = [matrix[i : i + rows] for i in range(0, len(matrix), rows)]
    blocks = [((i, 0), Matrices.dense(*p.shape, p.ravel(order="F").tolist())) for i, p in enumerate(parts)]
    return a.multiply(BlockMatrix(sc.parallelize(blocks, 1), rows, matrix.shape[1], *matrix.shape))


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """Fit on each different x of ``rows`` once; None when nothing varies."""
    different = stage(rows.select("x").distinct(), "whiten-different")
    fit_rows, n = numbered(different, "whiten-fit", different.count())
    if not n:
        return None
    sums = sums_of(fit_rows)
    a = block_matrix(centred(fit_rows, n, sums), n, len(sums))
    values, vectors = np.linalg.eigh(transposed_product(a) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    used = int(np.count_nonzero(values[:k] > max(values[0], 0) * LEAST_EIGENVALUE))
    if not used:
        return None
    vectors = vectors[:, :used]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(used)] < 0, -1.0, 1.0)
    matrix = vectors / np.sqrt(values[:used])
    error = float(np.abs(transposed_product(times(a, matrix)) / n - np.eye(used)).max())
    return Whitening(n, sums, matrix, values[:used] / values.sum(), error)


def project(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened array<double>) of every row (id, x)."""
    from pyspark.ml.functions import vector_to_array

    dealt, total = numbered(rows, "whiten-rows", rows.count())
    rows = stage(centred(dealt, model.n, model.sums), "whiten-centred")
    a = block_matrix(rows, total, len(model.sums))
    out = times(a, model.matrix).toIndexedRowMatrix()
    got = callMLlibFunc("getIndexedRows", out._java_matrix_wrapper._java_model)
    got = got.select(F.col("index").alias("row"), vector_to_array("vector").alias("whitened"))
    return rows.select("row", "id", "deviation").join(got, "row").drop("row")


def whiten(df: DataFrame, id: str = "vec_id", vec: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row per used row and component: id, component, n, deviation, whitened, explained, identity_error."""
    kind = df.schema[id].dataType.simpleString()
    rows = stage(integer_rows(df, id, vec), "whiten-integers")
    model = fit(rows, k)
    if model is None:
        schema = f"`{id}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return df.sparkSession.createDataFrame([], schema)
    explained = F.lit(model.explained.tolist())
    out = project(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
