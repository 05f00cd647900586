"""Language-model scoring with a weighted backoff automaton.

States are n-grams, arcs carry the smoothed log-probability of a token, and a
missing arc is replaced by a failure arc to the state without the oldest token,
with the backoff weight of the state that is left.  Smoothing is Dirichlet
(MacKay and Peto) down to additive unigrams, which is normalised exactly:

    P(w | h) = (c(hw) + K P(w | h')) / (c(h) + K)

The model has every n-gram of the training documents, so it grows with the
corpus and no task ever holds it whole.  Documents form blocks of bounded size.
Each block sends its distinct n-grams with its own training counts, packed by
hash slice; a slice adds up the blocks and answers only where another block
contributes.  A block's own n-grams with their total counts are the part of the
automaton that its documents can reach, so traversing that part is exact.

An n-gram travels once per block however frequent it is, so there are no hot
keys.  Null texts are empty: one end token.  Without training documents every
token is unknown.  Repeated rows give repeated rows and count repeatedly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.llm.common import _STEP, TextBatch, mix64, slices, stage

#: Longest n-gram of the production model.
ORDER = 2
#: Dirichlet concentration of each higher order.
CONCENTRATION = 50.0
#: Added to each unigram count.
ADD = 0.1
#: Text bytes of a block, and of the corpus for each hash slice.
BLOCK_BYTES = 12 << 20
SLICE_TEXT = 8 << 20
#: Bytes of a block that a row takes besides its text.
_ROW_BYTES = 16

_START, _END = np.uint64(0x5A17C0DE00000001), np.uint64(0x5A17C0DE00000002)


class Tokens:
    """A block's token sequences, start, words, end, one document after the other."""

    def __init__(self, column: pa.Array):
        per_doc, words = [], []
        for part in slices(pa.RecordBatch.from_arrays([column], ["t"]), 0):  # bounds the memory of hashing
            w = TextBatch(part.column(0)).words(fold=True)
            per_doc.append(w.per_doc)
            words.append(w.hash)
        per_doc = np.concatenate(per_doc)
        size = per_doc + 2
        off = np.concatenate(([0], np.cumsum(size)))
        self.hash = np.empty(off[-1], dtype=np.uint64)
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        inner = np.ones(off[-1], dtype=bool)
        inner[off[:-1]] = inner[off[1:] - 1] = False
        self.hash[inner] = np.concatenate(words)
        self.hash[off[:-1]] = _START
        self.hash[off[1:] - 1] = _END
        self.is_start = np.zeros(off[-1], dtype=bool)
        self.is_start[off[:-1]] = True
        self.n_docs = len(size)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k-gram that ends at each position, and whether there is one."""
        acc = np.zeros(len(self.hash), dtype=np.uint64)
        ok = np.zeros(len(self.hash), dtype=bool)
        ok[k - 1 :] = self.doc[k - 1 :] == self.doc[: len(self.doc) - k + 1]
        for j in range(k - 1, -1, -1):
            shifted = np.zeros_like(acc)
            shifted[j:] = self.hash[: len(self.hash) - j]
            acc = acc * _STEP + shifted
        return mix64(acc + np.uint64(k)), ok


def local_counts(tokens: Tokens, train: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams of a block with its training counts: words and ends, then starts and longer n-grams."""
    weight = train[tokens.doc]
    out, rest = [], []
    for k in range(1, order + 1):
        g, ok = tokens.grams(k)
        real = ok & ~tokens.is_start
        for at in (real, tokens.is_start) if k == 1 else (real,):
            key, inv = np.unique(g[at], return_inverse=True)
            pair = (key, np.bincount(inv, weights=weight[at], minlength=len(key)).astype(np.uint32))
            (out if k == 1 and at is real else rest).append(pair)
    key = np.concatenate([k for k, _ in rest])
    sort = np.argsort(key)
    return [*out, (key[sort], np.concatenate([c for _, c in rest])[sort])]


def slice_edges(key: np.ndarray, n_slices: int) -> np.ndarray:
    """Where each hash range begins in sorted keys (n_slices + 1 positions)."""
    which = ((key >> np.uint64(32)) * np.uint64(n_slices)) >> np.uint64(32)
    return np.searchsorted(which, np.arange(n_slices + 1, dtype=np.uint64))


def pack(key: np.ndarray) -> bytes:
    """Sorted hashes as the first one and six-byte differences (eight bytes where one of them is larger)."""
    step = np.diff(key)
    width = 6 if not len(step) or int(step.max()) < 1 << 48 else 8
    return bytes([width]) + key[:1].tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(rest) + 1, 8), dtype=np.uint8)
    out[1:, :width] = rest
    out = out.reshape(-1).view(np.uint64)
    out[0] = np.frombuffer(data[1:9], np.uint64)[0]
    return np.cumsum(out, dtype=np.uint64)


def _checksum(tokens: Tokens) -> int:
    return int(np.bitwise_xor.reduce(tokens.hash) >> np.uint64(1)) if len(tokens.hash) else 0


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int, limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Blocks of a scan partition in scan order; the number holds partition and position.

    A block ends before the row that would pass the limit, so the cuts depend on the rows alone, not on how they
    are dealt into batches: a stage writes with smaller batches than the query's last job.
    """
    base, k = TaskContext.get().partitionId() << 24, 0
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[int, pa.RecordBatch]:
        return base + k, pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        text = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
        upto = np.cumsum(text.astype(np.int64) + _ROW_BYTES)
        at = before = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(upto, before + limit - size, side="right"))
            if not held:
                to = max(to, at + 1)  # a row longer than the limit is a block
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(upto[to - 1]) - before
                at, before = to, int(upto[to - 1])
            if at < batch.num_rows:
                yield block()
                held, size, k = [], 0, k + 1
    if held:
        yield block()


_REQUEST = "slice int, block long, kind int, keys binary, counts binary"
_ANSWER = "block long, kind int, slice int, more binary, vocabulary long, tokens long, checksum long"


def requests(docs: DataFrame, order: int, n_slices: int) -> DataFrame:
    """Per block and hash slice the packed n-grams with training counts (sorted by hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches, 2, BLOCK_BYTES):
            tokens = Tokens(b.column(2))
            train = ~np.asarray(b.column(1).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
            check = _checksum(tokens)
            counted = local_counts(tokens, train, order)
            del tokens
            rows = [(block % n_slices, block, 0, b"", check.to_bytes(8, "little"))]
            for kind, (key, count) in enumerate(counted, start=1):
                edge = slice_edges(key, n_slices)
                for s in np.flatnonzero(np.diff(edge)):
                    at = slice(edge[s], edge[s + 1])
                    rows.append((int(s), block, kind, pack(key[at]), count[at].tobytes()))
            for k in range(0, len(rows), 64):
                cols = list(zip(*rows[k : k + 64]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))],
                    ["slice", "block", "kind", "keys", "counts"],
                )

    return docs.mapInArrow(run, _REQUEST)


def answers(asked: DataFrame) -> DataFrame:
    """Per slice: what the other blocks add to each block's counts, in the order it asked; and the slice's totals."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        at_slice = key[0].as_py()
        kind = t.column("kind").to_numpy()
        block = t.column("block").to_numpy()
        keys, counts = t.column("keys"), t.column("counts")
        rows = []
        for i in np.flatnonzero(kind == 0):
            rows.append((int(block[i]), 0, at_slice, b"", 0, 0, int.from_bytes(counts[i].as_py(), "little")))
        for k in (1, 2):
            mine = np.flatnonzero(kind == k)
            if not len(mine):
                continue
            asked_keys = [unpack(keys[i].as_py()) for i in mine]
            own = [np.frombuffer(counts[i].as_py(), np.uint32) for i in mine]
            every, inv = np.unique(np.concatenate(asked_keys), return_inverse=True)
            sizes = [len(x) for x in asked_keys]
            del asked_keys
            total = np.bincount(inv, weights=np.concatenate(own), minlength=len(every)).astype(np.int64)
            if k == 1:
                rows.append((-1, 0, at_slice, b"", int((total > 0).sum()), int(total.sum()), 0))
            end = 0
            for i, n, c in zip(mine, sizes, own):
                more = (total[inv[end : end + n]] - c).astype(np.uint32)
                end += n
                if more.any():
                    rows.append((int(block[i]), k, at_slice, more.tobytes(), 0, 0, 0))
        names = ["block", "kind", "slice", "more", "vocabulary", "tokens", "checksum"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows)) if rows else [[]] * len(names)
        return pa.table([pa.array(c, ty) for c, ty in zip(cols, types)], names)

    return asked.groupBy("slice").applyInArrow(run, _ANSWER)


class BackoffAutomaton:
    """The states and arcs that one block can reach, with total counts."""

    def __init__(self, key: np.ndarray, count: np.ndarray, n_tokens: int, vocabulary: int, order: int, concentration: float):
        sort = np.argsort(key)
        self.key, self.count = key[sort], count[sort].astype(np.float64)
        self.unigram_norm = n_tokens + ADD * (vocabulary + 1)
        self.order, self.k = order, concentration

    def counts(self, gram: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(gram))
        i = np.minimum(np.searchsorted(self.key, gram), len(self.key) - 1)
        return np.where(self.key[i] == gram, self.count[i], 0.0)

    def traverse(self, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token position: log10 weight from its state, unigram log10 weight, whether the token is known.

        The state before a token is the longest context the automaton knows,
        which the last ``order - 1`` tokens determine; so all positions take
        their step at once, order by order: an arc where there is one, else the
        failure weight of the context and the arc of the shorter one.
        """
        g, _ = tokens.grams(1)
        c = self.counts(g)
        p = (c + ADD) / self.unigram_norm
        base, known = np.log10(p), c > 0
        log_p = base
        for k in range(2, self.order + 1):
            gram, ok = tokens.grams(k)
            context = tokens.grams(k - 1)[0]
            state = np.zeros(len(gram))
            state[1:] = self.counts(context[:-1])
            arc = np.where(ok, self.counts(gram), 0.0)
            state = np.where(ok, state, 0.0)
            failure = np.log10(self.k / (state + self.k))
            with_arc = (arc + self.k * p) / (state + self.k)
            log_p = np.where(arc > 0, np.log10(with_arc), np.where(ok, failure, 0.0) + log_p)
            p = np.where(ok, with_arc, p)
        return log_p, base, known


def lm_scores(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    held_out: str = "held_out",
    order: int = ORDER,
    concentration: float = CONCENTRATION,
) -> DataFrame:
    """Per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    Rows with a true ``held_out`` are scored but not learned from.
    """
    src = docs.select(doc_id, F.col(held_out).cast("boolean").alias(held_out), text)
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_slices = int(size // SLICE_TEXT) + 1
    got = stage(answers(requests(src, order, n_slices)), "lm-answers")
    totals = got.filter("block = -1").agg(F.sum("vocabulary").alias("v"), F.sum("tokens").alias("n")).first()
    vocabulary, n_tokens = int(totals["v"] or 0), int(totals["n"] or 0)

    id_field, flag = docs.schema[doc_id], T.StructField(held_out, T.BooleanType())
    blocked_schema = T.StructType([T.StructField("block", T.LongType()), id_field, flag, T.StructField(text, T.StringType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, b in _blocks(batches, 2, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(b.num_rows, block)), b.column(0), b.column(1), b.column(2)], ["block", doc_id, held_out, text]
            )

    schema = T.StructType(
        [id_field, flag]
        + [T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")]
        + [T.StructField(n, T.DoubleType()) for n in ("base_score", "score")]
    )
    names = [f.name for f in schema]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], type=f.type) for f in left.select([doc_id, held_out]).schema] + [pa.array([], t) for t in (pa.int64(),) * 3 + (pa.float64(),) * 2], names)
        left = left.combine_chunks()
        tokens = Tokens(left.column(text).chunk(0))
        check = sum(right.column("checksum").to_pylist())
        if check != _checksum(tokens):
            raise RuntimeError("the two scans of the documents did not form the same blocks")
        train = ~np.asarray(left.column(held_out).chunk(0).fill_null(False).to_numpy(zero_copy_only=False), dtype=bool)
        counted = [(k, c.astype(np.int64), slice_edges(k, n_slices)) for k, c in local_counts(tokens, train, order)]
        for kind, s, more in zip(*(right.column(c).to_pylist() for c in ("kind", "slice", "more"))):
            if kind:
                _, c, edge = counted[kind - 1]
                c[edge[s] : edge[s + 1]] += np.frombuffer(more, np.uint32)
        key, count = (np.concatenate([x[j] for x in counted]) for j in (0, 1))
        log_p, base, known = BackoffAutomaton(key, count, n_tokens, vocabulary, order, concentration).traverse(tokens)
        real = ~tokens.is_start
        total = lambda v: np.bincount(tokens.doc[real], weights=v[real], minlength=tokens.n_docs)
        return pa.table(
            [
                left.column(doc_id),
                left.column(held_out),
                pa.array(np.bincount(tokens.doc[real], minlength=tokens.n_docs).astype(np.int64)),
                pa.array(total(known.astype(float)).astype(np.int64)),
                pa.array(np.full(tokens.n_docs, n_tokens, dtype=np.int64)),
                pa.array(total(base)),
                pa.array(total(log_p)),
            ],
            names,
        )

    blocked = src.mapInArrow(number, blocked_schema)
    back = got.filter("block >= 0").select("block", "kind", "slice", "more", "checksum")
    return blocked.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, schema)
