"""Quality classifier: a generalised additive model with pairwise interactions.

Features of every whole text are computed once, vectorised per Arrow slice, and
written as a narrow stage table.  The model is fitted on a bounded sample of
labelled rows: one feature after the other, in cycles, a shallow tree over the
feature's bins is fitted to the gradient and added, slowed down, to that
feature's lookup table; the pairs that explain most of what is left get
two-dimensional tables in the same way.  A score is the logistic of a sum of
table entries: a binary search and an addition per feature.

Null or empty texts have defined features (zeros) and get a score.  Without
labels every score is 0.5; with labels of one kind only it is that share.
Repeated rows give repeated rows; a row that is labelled twice counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.llm.common import TextBatch, slices, stage
from spate.llm.quality_rules import plain_counts

#: Labelled rows used for fitting (a documented bound; taken by hash order).
MAX_LABELLED = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 60
PAIR_ROUNDS = 30
RATE = 0.15
LEAVES = 4
THRESHOLD = 0.5

FEATURES = [
    "log_words", "word_length", "symbol_share", "repeat_share", "dup_lines", "upper_share", "digit_share", "punct_share",
    "exclaim_share", "pipe_share", "wide_share", "lines_per_word", "distinct_share", "short_share", "end_share", "hot_word_share",
]


def features(tb: TextBatch) -> np.ndarray:
    """One row of numbers per document; only the text is looked at."""
    data, off, n = tb.data, tb.offsets, tb.n
    size = np.diff(off)

    def per_doc(flag: np.ndarray) -> np.ndarray:
        t = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return (t[off[1:]] - t[off[:-1]]).astype(float)

    def among(chars: str) -> np.ndarray:
        table = np.zeros(256, dtype=bool)
        table[[ord(c) for c in chars]] = True
        return per_doc(table[data])

    base = plain_counts(tb)
    words = base["n_words"].astype(float)
    w = tb.words(fold=True)
    one = np.maximum(words, 1)
    chars = np.maximum(base["word_chars"], 1)
    # Distinct words and the most frequent word's share, from runs of equal (document, word) keys.
    pair = np.sort((w.doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    run = np.diff(np.append(first, len(pair)))
    doc = (pair[first] >> np.uint64(40)).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    distinct = np.bincount(doc, minlength=n).astype(float)
    most = np.zeros(n)
    np.maximum.at(most, doc, run)
    lines = per_doc(data == 10) + (size > 0)
    ends = np.zeros(len(data), dtype=bool)
    if len(w.start):
        last = w.start + w.length - 1
        ends[last] = np.isin(data[last], [46, 33, 63])
    return np.stack(
        [
            np.log1p(words),
            chars / one * (words > 0),
            base["n_symbols"] / chars,
            base["n_repeat_words"] / one,
            base["n_dup_lines"] / np.maximum(lines, 1),
            per_doc((data >= 65) & (data <= 90)) / chars,
            per_doc((data >= 48) & (data <= 57)) / chars,
            among(".,;:'\"()-") / chars,
            among("!?") / chars,
            among("|{}[]=/\\_~^`+@") / chars,
            per_doc(data >= 0xC0) / chars,
            lines / one,
            distinct / one,
            np.bincount(w.doc[w.length <= 3], minlength=n) / one,
            per_doc(ends) / one,
            most / one,
        ],
        axis=1,
    )


def feature_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one float column per feature."""
    schema = T.StructType([docs.schema[doc_id]] + [T.StructField(f, T.FloatType()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                x = features(TextBatch(part.column(1))).astype(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(np.ascontiguousarray(x[:, k])) for k in range(x.shape[1]))], [doc_id, *FEATURES]
                )

    return docs.select(doc_id, text).mapInArrow(run, schema)


# ---------------------------------------------------------------------------
# The additive model
# ---------------------------------------------------------------------------


@dataclass
class Additive:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.intercept)
        for k, (e, t) in enumerate(zip(self.edges, self.tables)):
            s += t[np.searchsorted(e, x[:, k], side="right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.pair_edges)]
            for (a, b), t in zip(self.pairs, self.pair_tables):
                s += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def _cuts(g: np.ndarray, h: np.ndarray, leaves: int, l2: float = 1.0) -> np.ndarray:
    """A shallow tree over ordered bins: best splits first; returns the leaf value of each bin."""
    gs, hs = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))

    def gain(a: int, b: int) -> tuple[float, int]:
        at = np.arange(a + 1, b)
        if not len(at):
            return 0.0, -1
        left, right = gs[at] - gs[a], gs[b] - gs[at]
        v = left**2 / (hs[at] - hs[a] + l2) + right**2 / (hs[b] - hs[at] + l2) - (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + l2)
        k = int(np.argmax(v))
        return float(v[k]), int(at[k])

    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = max(((*gain(a, b), a, b) for a, b in parts), key=lambda q: q[0])
        if best[0] <= 1e-9:
            break
        _, at, a, b = best
        parts.remove((a, b))
        parts += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + l2)
    return out


def _quantile_edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Two levels over a pair's bins: split one axis, then the other axis within each side; the better order."""

    def one_way(g, h):
        side = _cuts(g.sum(1), h.sum(1), 2)
        out, gain = np.zeros_like(g), 0.0
        for v in np.unique(side):
            rows = side == v
            leaf = _cuts(g[rows].sum(0), h[rows].sum(0), 2)
            out[rows] = leaf
            gain += float((leaf * g[rows].sum(0)).sum())
        return out, gain

    a, ga = one_way(g, h)
    b, gb = one_way(g.T, h.T)
    return a if ga >= gb else b.T


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    """Cyclic boosting of per-feature tables, then of the strongest pairs' tables."""
    n, width = x.shape
    rate = (y.sum() + 0.5) / (n + 1)
    m = Additive(float(np.log(rate / (1 - rate))))
    m.edges = [_quantile_edges(x[:, k], BINS) for k in range(width)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(m.edges)]
    s = np.full(n, m.intercept)

    def slope():
        p = 1 / (1 + np.exp(-s))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slope()
            size = len(m.tables[k])
            step = RATE * _cuts(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size), LEAVES)
            m.tables[k] += step
            s += step[bins[k]]
    m.pair_edges = [_quantile_edges(x[:, k], PAIR_BINS) for k in range(width)]
    coarse = [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(m.pair_edges)]
    g, h = slope()

    def grid(a, b, v):
        na, nb = len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1
        return np.bincount(coarse[a] * nb + coarse[b], v, na * nb).reshape(na, nb)

    strength = {}
    for a in range(width):
        for b in range(a + 1, width):
            ga = grid(a, b, g)
            strength[a, b] = float((_pair_tree(ga, grid(a, b, h)) * ga).sum())
    m.pairs = sorted(strength, key=lambda q: (-strength[q], q))[:PAIRS]
    m.pair_tables = [np.zeros((len(m.pair_edges[a]) + 1, len(m.pair_edges[b]) + 1)) for a, b in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(m.pairs):
            g, h = slope()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))
            m.pair_tables[k] += step
            s += step[coarse[a], coarse[b]]
    return m


def fit(table: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality", limit: int = MAX_LABELLED) -> Additive:
    """Fit on at most ``limit`` labelled rows of a feature table (narrow rows join, no text moves)."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("__id"), (F.col(label) == 1).cast("int").alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id", "__y")
        .limit(limit)
    )
    # At most ``limit`` rows of an id and a label: a proven bound for the broadcast.
    rows = table.join(F.broadcast(ids), table[doc_id] == F.col("__id")).orderBy(F.xxhash64("__id"), *FEATURES, "__y").limit(limit).toPandas()
    y = rows["__y"].to_numpy(float)
    if not len(y):
        return Additive(0.0)
    if y.min() == y.max():
        return Additive(30.0 if y[0] else -30.0)
    return fit_additive(rows[FEATURES].to_numpy(np.float32), y)


def score(table: DataFrame, model: Additive, doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted for every row of a feature table."""
    shared = table.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([table.schema[doc_id], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(k + 1).to_numpy() for k in range(len(FEATURES))], axis=1)
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [doc_id, "score", "predicted"])

    return table.select(doc_id, *FEATURES).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Features once, fit on the labelled rows given, score every document row."""
    table = stage(feature_table(docs, doc_id, text), "quality-features")
    return score(table, fit(table, labels, doc_id, label), doc_id)
