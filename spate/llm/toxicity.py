"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

1. A bounded sample of labelled documents (``MAX_LABELLED`` rows) is written
   once as a stage table; labels of held-out rows never enter it.
2. Word and word-beginning features of toxic documents are counted by distinct
   contexts (so copies of one document count once) and held against the words
   of clean documents.  Features that are strongly associated label the tokens of the
   toxic sample documents; all tokens of clean documents are labelled clean.
3. A two-state chain (clean, toxic) is fitted to the labelled token windows by
   gradient ascent on the conditional likelihood.
4. Forward-backward marginals of every token of every whole text are combined
   into a document score by a logistic curve fitted on the sample; tokens above
   one half are the offending spans.

Texts: null or empty texts have no tokens and get the score of a document
without toxic tokens.  Without usable labels of both kinds every score is the
share of toxic labels (0 without any).  Repeated rows give repeated rows; a
document that is labelled twice counts with each label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.llm.common import ALNUM_BYTES, TextBatch, Words, keep_rows, mix64, slices, stage

#: Labelled documents used for fitting (a documented bound; taken by hash order).
MAX_LABELLED = 20_000
#: Candidate and selected association features.
MAX_CANDIDATES = 65_536
MAX_FEATURES = 4_096
#: Token windows given to the chain's fit, and their length.
MAX_WINDOWS = 4_000
WINDOW = 48
PREFIXES = (3, 4, 5, 6)
#: Least likelihood-ratio statistic of an associated feature.
LEAST_G = 20.0
#: Least log-odds of an associated feature.
LEAST_ODDS = 4.0
THRESHOLD = 0.3


def _words(batch: TextBatch) -> Words:
    return batch.words(fold=True, word_bytes=ALNUM_BYTES, prefixes=PREFIXES)


def _features(w: Words) -> list[np.ndarray]:
    """One hash array per feature kind (whole word, then beginnings); 0 = absent."""
    return [w.hash, *(w.prefix[k] for k in PREFIXES)]


def labelled_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, limit: int) -> DataFrame:
    """(toxic, text) of at most ``limit`` labelled rows; only ids and labels are sorted for it."""
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .select(F.col(doc_id).alias("__id"), (F.col(label) == 1).alias("toxic"))
        .orderBy(F.xxhash64("__id"), "__id", "toxic")
        .limit(limit)
    )
    # At most ``limit`` rows of an id and a flag: a proven bound for the broadcast.
    return docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).join(F.broadcast(ids), "__id").select("toxic", "text")


def _as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def toxic_contexts(sample: DataFrame) -> DataFrame:
    """(feature, k1): distinct contexts (both neighbours) of each feature in toxic documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                w = _words(TextBatch(part.column(0)))
                if not len(w.hash):
                    continue
                # Contexts end with their document: the counts do not depend on how rows are batched.
                near = w.doc[1:] == w.doc[:-1]
                left = np.concatenate(([np.uint64(0)], np.where(near, w.hash[:-1], np.uint64(0))))
                right = np.concatenate((np.where(near, w.hash[1:], np.uint64(0)), [np.uint64(0)]))
                ctx = mix64(left * np.uint64(3) + right)
                for f in _features(w):
                    at = np.flatnonzero(f)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([_as_signed(f[at]), _as_signed(ctx[at])], ["feature", "ctx"])

    pairs = sample.filter("toxic").select("text").mapInArrow(run, "feature long, ctx long").distinct()
    return pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("k1"))


def clean_occurrences(sample: DataFrame, candidates: np.ndarray) -> DataFrame:
    """(feature, k0): occurrences of each candidate feature in clean documents; feature 0: all their words."""
    shared = sample.sparkSession.sparkContext.broadcast(candidates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cand, count, words = shared.value, np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            for part in slices(batch, 0):
                w = _words(TextBatch(part.column(0)))
                words += len(w.hash)
                for f in _features(w):
                    i = np.minimum(np.searchsorted(cand, f), len(cand) - 1)
                    count += np.bincount(i[cand[i] == f], minlength=len(cand))
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*cand[at].view(np.int64).tolist(), 0], pa.int64()), pa.array([*count[at].tolist(), words], pa.int64())],
            ["feature", "n"],
        )

    out = sample.filter("not toxic").select("text").mapInArrow(run, "feature long, n long")
    return out.groupBy("feature").agg(F.sum("n").alias("k0"))


@dataclass
class Lexicon:
    """Associated features in hash order with their smoothed log-odds."""

    feature: np.ndarray
    weight: np.ndarray

    def evidence(self, w: Words) -> np.ndarray:
        """Per token: whole-word evidence, strongest beginning's evidence, number of associated features."""
        out = np.zeros((3, len(w.hash)))
        if len(self.feature):
            for k, f in enumerate(_features(w)):
                i = np.minimum(np.searchsorted(self.feature, f), len(self.feature) - 1)
                x = np.where(self.feature[i] == f, self.weight[i], 0.0)
                out[min(k, 1)] = np.maximum(out[min(k, 1)], x)
                out[2] += x > 0
        return out


def lexicon(sample: DataFrame) -> Lexicon:
    """Features whose rate among toxic contexts is far above that among the words of clean documents."""
    counted = stage(toxic_contexts(sample), "toxicity-contexts")
    n1 = counted.agg(F.sum("k1")).first()[0] or 0
    n1 /= 1 + len(PREFIXES)
    ranked = counted.filter("k1 >= 3").orderBy(F.desc("k1"), "feature").limit(MAX_CANDIDATES).toPandas()
    cand = ranked["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(cand)
    cand, k1 = cand[order], ranked["k1"].to_numpy(np.float64)[order]
    if not len(cand):
        return Lexicon(cand, k1)
    got = clean_occurrences(sample, cand).toPandas()
    n0 = max(float(got["k0"][got["feature"] == 0].sum()), 1.0)
    got = got[got["feature"] != 0]
    k0 = np.zeros(len(cand))
    k0[np.searchsorted(cand, got["feature"].to_numpy(np.int64).view(np.uint64))] = got["k0"]
    p, k = n1 / (n1 + n0), k0 + k1
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * (k1 * np.log(k1 / (k * p)) + np.where(k0 > 0, k0 * np.log(k0 / (k * (1 - p))), 0))
    odds = np.log((k1 + 0.1) / n1) - np.log((k0 + 0.5) / n0)
    keep = np.flatnonzero((g >= LEAST_G) & (odds > LEAST_ODDS))
    keep = np.sort(keep[np.argsort(-g[keep], kind="stable")][:MAX_FEATURES])
    return Lexicon(cand[keep], np.minimum(odds[keep], 8.0))


# ---------------------------------------------------------------------------
# The chain
# ---------------------------------------------------------------------------


def design(ev: np.ndarray, w: Words, data: np.ndarray) -> np.ndarray:
    """Emission features per token: bias, own evidence, neighbours' evidence within the document, shape."""
    n = ev.shape[1]
    any_ = np.maximum(ev[0], ev[1])
    near = np.zeros(n)
    if n > 1:
        same = w.doc[1:] == w.doc[:-1]
        near[1:] += np.where(same, any_[:-1], 0)
        near[:-1] += np.where(same, any_[1:], 0)
    short = (w.length <= 2).astype(float)
    digit = ((data[w.start] >= 48) & (data[w.start] <= 57)).astype(float) if n else np.zeros(0)
    return np.stack([np.ones(n), ev[0] / 4, ev[1] / 4, np.minimum(ev[2], 3), near / 8, short, digit], axis=1)


@dataclass
class Chain:
    """Two-state chain: emission weights of the toxic state, transition and start log-potentials."""

    emit: np.ndarray
    trans: np.ndarray
    start: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """P(toxic) of every token of concatenated documents; ``first`` marks document starts.

        Forward-backward over one long chain whose links are cut at document
        starts.  The chain is laid out in about sqrt(n) columns: transfer
        matrices of the columns first, then the column ends in order, then all
        columns at once.
        """
        n = len(x)
        if n == 0:
            return np.zeros(0)
        rows = int(np.ceil(np.sqrt(n)))
        cols = -(-n // rows)
        e = np.ones(rows * cols)
        e[:n] = np.exp(np.clip(x @ self.emit, -30, 30))
        cut = np.ones(rows * cols, dtype=bool)
        cut[:n] = first
        e, cut = e.reshape(cols, rows).T, cut.reshape(cols, rows).T
        tr, st = np.exp(self.trans), np.exp(self.start)
        # m[i][j]: weight of going from state i into state j at this token.
        m = [[np.where(cut, st[j], tr[i, j]) * (e if j else 1.0) for j in (0, 1)] for i in (0, 1)]
        p = [[np.full(cols, float(i == j)) for j in (0, 1)] for i in (0, 1)]
        for t in range(rows):
            q = [[p[i][0] * m[0][j][t] + p[i][1] * m[1][j][t] for j in (0, 1)] for i in (0, 1)]
            z = q[0][0] + q[0][1] + q[1][0] + q[1][1]
            p = [[q[i][j] / z for j in (0, 1)] for i in (0, 1)]
        a_in, b_in = np.empty((cols, 2)), np.empty((cols, 2))
        a = (0.5, 0.5)
        for c in range(cols):
            a_in[c] = a
            u = a[0] * p[0][0][c] + a[1] * p[1][0][c]
            v = a[0] * p[0][1][c] + a[1] * p[1][1][c]
            a = (u / (u + v), v / (u + v))
        b = (0.5, 0.5)
        for c in range(cols - 1, -1, -1):
            b_in[c] = b
            u = p[0][0][c] * b[0] + p[0][1][c] * b[1]
            v = p[1][0][c] * b[0] + p[1][1][c] * b[1]
            b = (u / (u + v), v / (u + v))
        alpha = np.empty((rows, cols))
        a0, a1 = a_in[:, 0], a_in[:, 1]
        for t in range(rows):
            u, v = a0 * m[0][0][t] + a1 * m[1][0][t], a0 * m[0][1][t] + a1 * m[1][1][t]
            a0, a1 = u / (u + v), v / (u + v)
            alpha[t] = a1
        out = np.empty((rows, cols))
        b0, b1 = b_in[:, 0], b_in[:, 1]
        for t in range(rows - 1, -1, -1):
            out[t] = alpha[t] * b1 / (alpha[t] * b1 + (1 - alpha[t]) * b0)
            u, v = m[0][0][t] * b0 + m[0][1][t] * b1, m[1][0][t] * b0 + m[1][1][t] * b1
            b0, b1 = u / (u + v), v / (u + v)
        return out.T.reshape(-1)[:n]


def fit_chain(x: np.ndarray, y: np.ndarray, mask: np.ndarray, rounds: int = 80, l2: float = 1e-3) -> Chain:
    """Maximise the conditional log-likelihood of windows x[s, t, :] with states y[s, t] (mask: real tokens)."""
    s, t, f = x.shape
    theta = np.zeros(f + 6)
    theta[0] = -3.0
    step, m1, m2 = 0.1, np.zeros_like(theta), np.zeros_like(theta)
    pair = mask[:, 1:] & mask[:, :-1]
    n = max(int(mask.sum()), 1)
    for r in range(1, rounds + 1):
        emit, tr, st = theta[:f], theta[f : f + 4].reshape(2, 2), theta[f + 4 :]
        e = np.stack([np.zeros((s, t)), np.clip(x @ emit, -30, 30)], axis=2)
        alpha, beta = np.empty((s, t, 2)), np.zeros((s, t, 2))
        alpha[:, 0] = st + e[:, 0]
        for k in range(1, t):
            nxt = np.logaddexp(alpha[:, k - 1, :1] + tr[0], alpha[:, k - 1, 1:] + tr[1]) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], nxt, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            into = e[:, k + 1] + beta[:, k + 1]
            prev = np.logaddexp(tr[:, 0] + into[:, :1], tr[:, 1] + into[:, 1:])
            beta[:, k] = np.where(mask[:, k + 1, None], prev, beta[:, k + 1])
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
        grad = np.zeros_like(theta)
        grad[:f] = np.einsum("st,stf->f", np.where(mask, y - p1, 0.0), x)
        for i in (0, 1):
            for j in (0, 1):
                lp = alpha[:, :-1, i] + tr[i, j] + e[:, 1:, j] + beta[:, 1:, j] - z[:, None]
                seen = (y[:, :-1] == i) & (y[:, 1:] == j)
                grad[f + 2 * i + j] = np.where(pair, seen - np.exp(np.minimum(lp, 0)), 0.0).sum()
        grad[f + 4] = (y[:, 0] == 0).sum() - (1 - p1[:, 0]).sum()
        grad[f + 5] = -grad[f + 4]
        grad = grad / n - l2 * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        theta = theta + step * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return Chain(theta[:f], theta[f : f + 4].reshape(2, 2), theta[f + 4 :])


def token_windows(sample: DataFrame, lex: Lexicon, limit: int = MAX_WINDOWS) -> DataFrame:
    """Labelled windows of ``WINDOW`` tokens: (features row by row, states), at most ``limit`` of each kind.

    Toxic documents give the windows that hold labelled tokens; clean documents
    give every window with evidence and, by hash, some without.
    """
    shared = sample.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                tb = TextBatch(part.column(1))
                w = _words(tb)
                ev = shared.value.evidence(w)
                x = design(ev, w, tb.data)
                toxic = np.asarray(part.column(0).to_pylist(), dtype=bool)[w.doc] if len(w.doc) else np.zeros(0, bool)
                hot = np.maximum(ev[0], ev[1]) > 0
                block = np.stack([w.doc, (np.arange(len(w.doc)) - w.doc_off[w.doc]) // WINDOW], axis=1)
                edge = np.flatnonzero(np.any(np.diff(block, axis=0, prepend=-1) != 0, axis=1))
                xs, ys, key = [], [], []
                for a, b in zip(edge, np.append(edge[1:], len(w.doc))):
                    h = int(mix64(w.hash[a : a + 1] + np.uint64(b - a))[0])
                    if hot[a:b].any() or h % 64 == 0:
                        xs.append(x[a:b].ravel())
                        ys.append((hot & toxic)[a:b].astype(np.int8))
                        key.append(((h >> 1) - (1 << 62)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.int8())), pa.array(key, pa.int64())], ["x", "y", "key"]
                )

    rows = sample.select("toxic", "text").mapInArrow(run, "x array<double>, y array<tinyint>, key long")
    has = F.exists("y", lambda v: v > 0)
    pick = lambda c: rows.filter(c).orderBy("key", F.size("y")).limit(limit // 2)
    return pick(has).unionByName(pick(~has))


@dataclass
class Model:
    lex: Lexicon
    chain: Chain | None
    curve: np.ndarray  # intercept and slopes of the document score

    def tokens(self, tb: TextBatch) -> tuple[Words, np.ndarray]:
        w = _words(tb)
        if self.chain is None:
            return w, np.zeros(len(w.hash))
        first = np.ones(len(w.doc), dtype=bool)
        first[1:] = w.doc[1:] != w.doc[:-1]
        return w, self.chain.marginals(design(self.lex.evidence(w), w, tb.data), first)

    def summary(self, tb: TextBatch) -> tuple[Words, np.ndarray, np.ndarray]:
        """Words, marginals, and per document: log-odds of the most toxic token, log(1 + likely toxic tokens)."""
        w, p = self.tokens(tb)
        top = np.zeros(tb.n)
        has = w.per_doc > 0
        if has.any():
            top[has] = np.maximum.reduceat(p, w.doc_off[:-1][has])
        top = np.clip(top, 1e-4, 1 - 1e-4)
        many = np.bincount(w.doc, weights=np.where(p >= 0.5, p, 0.0), minlength=tb.n)
        return w, p, np.stack([np.log(top / (1 - top)), np.log1p(many)], axis=1)

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + z @ self.curve[1:], -30, 30)))


def fit_curve(z: np.ndarray, y: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps, slopes kept at 0 or above."""
    a = np.column_stack([np.ones(len(z)), z])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a / len(a) + l2 * np.eye(len(b))
        b = b + np.clip(np.linalg.solve(h, a.T @ (y - p) / len(a) - l2 * b), -2, 2)
        b[1:] = np.maximum(b[1:], 0)
    return b


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED) -> Model:
    sample = stage(labelled_sample(docs, labels, doc_id, text, label, limit), "toxicity-sample")
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = n.get(True, 0), n.get(False, 0)
    rate = n1 / (n1 + n0) if n1 + n0 else 0.0
    empty = Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    flat = Model(empty, None, np.array([np.log(max(rate, 1e-9) / max(1 - rate, 1e-9)), 0.0, 0.0]))
    if not n1 or not n0:
        return flat
    lex = lexicon(sample)
    rows = token_windows(sample, lex).toPandas()
    if not len(lex.feature) or not len(rows):
        return flat
    width = len(design(np.zeros((3, 0)), TextBatch(pa.array([""])).words(True), np.zeros(0, np.uint8)).T)
    x = np.zeros((len(rows), WINDOW, width))
    y, mask = np.zeros((len(rows), WINDOW)), np.zeros((len(rows), WINDOW), dtype=bool)
    for k, (a, b) in enumerate(zip(rows["x"], rows["y"])):
        x[k, : len(b)], y[k, : len(b)], mask[k, : len(b)] = np.asarray(a).reshape(-1, width), b, True
    model = Model(lex, fit_chain(x, y, mask), np.zeros(3))
    got = summaries(sample, model).toPandas()
    model.curve = fit_curve(got[["z0", "z1"]].to_numpy(), got["toxic"].to_numpy().astype(float))
    return model


def summaries(sample: DataFrame, model: Model) -> DataFrame:
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                z = shared.value.summary(TextBatch(part.column(1)))[2]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z[:, 0]), pa.array(z[:, 1])], ["toxic", "z0", "z1"])

    return sample.select("toxic", "text").mapInArrow(run, "toxic boolean, z0 double, z1 double")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, score, predicted, n_toxic, spans (``start:end`` code points, comma-joined)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [
            docs.schema[doc_id],
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
            T.StructField("n_toxic", T.LongType()),
            T.StructField("spans", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                tb = TextBatch(part.column(1))
                w, p, z = shared.value.summary(tb)
                s = shared.value.score(z)
                hot = np.flatnonzero(p >= 0.5)
                chars = np.concatenate(([0], np.cumsum((tb.data & 0xC0) != 0x80)))
                spans = [[] for _ in range(tb.n)]
                for d, a, b in zip(w.doc[hot], w.start[hot], w.length[hot]):
                    base = chars[tb.offsets[d]]
                    spans[d].append(f"{chars[a] - base}:{chars[a + b] - base}")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(s),
                        pa.array((s >= threshold).astype(np.int32)),
                        pa.array(np.array([len(x) for x in spans], dtype=np.int64)),
                        pa.array([",".join(x) for x in spans], pa.string()),
                    ],
                    [doc_id, "score", "predicted", "n_toxic", "spans"],
                )

    return docs.select(doc_id, text).mapInArrow(run, schema)


def remove_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rejects(column: pa.Array) -> np.ndarray:
        return shared.value.score(shared.value.summary(TextBatch(column))[2]) >= threshold

    return keep_rows(docs, text, rejects)
