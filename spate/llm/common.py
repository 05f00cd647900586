"""Helpers shared by the operators: stage files, id filters, and the Arrow text view.

``TextBatch`` exposes the UTF-8 bytes of an Arrow string column without copying
rows into Python objects, and hashes words and word n-grams for a whole batch
with numpy.  Spark partitions and shuffles the work; a batch never holds more
than ``SLICE_BYTES`` of text (or one document, when it alone is longer).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.session import ensure_checkpoint_dir

#: Text bytes handled by one numpy pass; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch while a stage table is written: workers and executors hold whole batches.
ARROW_ROWS = 1_000


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables below ``spark.checkpoint.dir`` (shared storage)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared stage folder and read it back.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = stage_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``ARROW_ROWS`` rows for the job that runs inside; the session's setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def crc_mod(col: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m`` (the contracts' fold rule)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(m)).cast("int")


def keep_rows(docs: DataFrame, text: str, rejects) -> DataFrame:
    """Rows of ``docs`` that ``rejects(text column)`` (one boolean per row) does not name; all columns stay.

    Map-only: a decision needs its own row only, so nothing is joined back.
    """
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(~np.asarray(rejects(part.column(at)), dtype=bool)))

    return docs.mapInArrow(run, docs.schema)


#: Bits of an id filter: 1 MB, whatever the number of ids.
FILTER_BITS = 1 << 23
_FILTER_HASHES = 3
_FILTER_BLOCK = 1 << 15


def _filter_positions(col: str) -> list[Column]:
    return [F.pmod(F.xxhash64(F.col(col), F.lit(k)), F.lit(FILTER_BITS)) for k in range(_FILTER_HASHES)]


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A Bloom filter of ``col`` as a fixed-size bitmap (1 MB on the driver, never more).

    It only thins a scan ahead of an exact join, so false positives cost work,
    not correctness; with very many ids it thins less and stays right.
    """
    pos = ids.select(F.explode(F.array(*_filter_positions(col))).alias("p"))
    blocks = pos.groupBy(F.floor(F.col("p") / _FILTER_BLOCK).cast("int").alias("b")).agg(
        F.collect_set(F.pmod(F.col("p"), F.lit(_FILTER_BLOCK)).cast("int")).alias("bits")
    )
    bitmap = np.zeros(FILTER_BITS, dtype=bool)
    for row in blocks.toLocalIterator():  # at most 256 rows of at most 32,768 numbers
        bitmap[row["b"] * _FILTER_BLOCK + np.asarray(row["bits"], dtype=np.int64)] = True
    return np.packbits(bitmap)


def maybe_in(df: DataFrame, col: str, packed: np.ndarray) -> DataFrame:
    """Rows of ``df`` with a boolean column ``__maybe``: whether ``col`` can be in the filter."""
    names = [c for c in df.columns]
    bits = df.sparkSession.sparkContext.broadcast(packed)
    src = df.withColumn("__p", F.array(*_filter_positions(col)))
    schema = T.StructType([*df.schema.fields, T.StructField("__maybe", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = bits.value
        for b in batches:
            p = b.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(-1, _FILTER_HASHES)
            hit = ((table_[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(names))), pa.array(hit)], names=[*names, "__maybe"]
            )

    return src.mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# Python side: vectorised text kernels
# ---------------------------------------------------------------------------


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = _splitmix(np.arange(1000, 1256, dtype=np.uint64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LEN = np.uint64(0x9E3779B97F4A7C15)

#: Lower-cases A-Z and nothing else.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_KEEP = np.arange(256, dtype=np.uint8)

#: Bytes of words ``[^\x20\x09-\x0D]+``.
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[32, 9, 10, 11, 12, 13]] = False


#: Bytes of words of letters and digits: 0-9 A-Z a-z and everything beyond ASCII.
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class TextBatch:
    """The texts of one Arrow column slice as one byte buffer with offsets (null = empty)."""

    def __init__(self, column: pa.Array):
        if pa.types.is_null(column.type):
            column = column.cast(pa.string())
        arr = pc.fill_null(column, "") if column.null_count else column
        wide = pa.types.is_large_string(arr.type)
        off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)
        off = off[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
        data = arr.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = raw[off[0] : off[-1]]
        self.offsets = off - off[0]
        self.n = len(arr)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self, fold: bool, word_bytes: np.ndarray = WORD_BYTES, prefixes: tuple[int, ...] = ()) -> "Words":
        return Words(self, fold, word_bytes, prefixes)


class Words:
    """All words of a batch: start byte, byte length, document index and 64-bit hash.

    ``prefix[k]`` is the hash of the first k bytes of each word (0 where the
    word is not longer than that).
    """

    def __init__(self, batch: TextBatch, fold: bool, word_bytes: np.ndarray, prefixes: tuple[int, ...]):
        data, off, n = batch.data, batch.offsets, len(batch.data)
        self.n_docs = batch.n
        inside = word_bytes[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = off[1:-1][off[1:-1] < n]
        first[cuts] |= inside[cuts]  # words do not run on from one document to the next
        self.start = np.flatnonzero(first)
        self.doc = np.searchsorted(off[1:], self.start, side="right")
        self.per_doc = np.bincount(self.doc, minlength=batch.n).astype(np.int64)
        self.doc_off = np.concatenate(([0], np.cumsum(self.per_doc)))
        if not len(self.start):
            self.length = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.prefix = {k: self.hash for k in prefixes}
            return
        self.length = np.add.reduceat(inside, self.start, dtype=np.int64)
        s0 = self.start[0]
        span = np.diff(np.append(self.start, n))
        pos = np.arange(s0, n, dtype=np.int64) - np.repeat(self.start, span)
        weight = np.cumprod(np.full(int(self.length.max()), _STEP, dtype=np.uint64))
        value = np.where(inside, _BYTE[(FOLD if fold else _KEEP)[data]], np.uint64(0))[s0:]
        value *= weight[np.minimum(pos, len(weight) - 1)]
        self.hash = mix64(np.add.reduceat(value, self.start - s0) + self.length.astype(np.uint64) * _LEN)
        self.prefix = {}
        for k in prefixes:
            part = np.add.reduceat(np.where(pos < k, value, np.uint64(0)), self.start - s0)
            self.prefix[k] = np.where(self.length > k, mix64(part + np.uint64(~k % (1 << 64))), np.uint64(0))

    def ngrams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all k-word windows that lie in one document, and the index of their first word."""
        m = len(self.hash) - k + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:m] == self.doc[k - 1 :])
        acc = np.zeros(m, dtype=np.uint64)
        for j in range(k):
            acc = acc * _STEP + self.hash[j : j + m]
        return mix64(acc[at] + np.uint64(k * int(_LEN) % (1 << 64))), at


def slices(batch: pa.RecordBatch, text_at: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch so that each part has at most ``limit`` text bytes (or one row)."""
    column = batch.column(text_at)
    if pa.types.is_null(column.type):
        yield batch
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, batch.num_rows
    while start < n:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end
    if n == 0:
        return
