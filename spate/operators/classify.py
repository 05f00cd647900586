"""Relevance classification: balancing, exact splits, an MLlib pipeline, scoring
and metrics.

M15 ``undersample``, M16 ``split``, M17 ``train``, M18 ``predict`` and
``predict_with`` (a model of the user's own),
M19 ``with_loss``, A17 ``confusion``, A18 ``binary_metrics``, F15 ``outcome``,
F16 ``error_slices``.

Random steps take a ``seed`` (D12) and are exact: rows are ordered by a seeded
key and cut at exact counts with a distributed rank, not sampled.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spate.operators.groups import global_rank
from spate.session import cut_lineage

LABELS = ("relevant", "mentions_impact")


def seeded_key(id_col, seed: int = 0) -> Column:
    """A seeded pseudo-random order key: MD5 of ``seed:id`` in hexadecimal.

    Works for ids of any type, and every seed gives an order of its own; SQL
    engines produce the same text.
    """
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws(":", F.lit(str(seed)), c.cast("string")).cast("binary"))


def _ordered(df: DataFrame, id: str, seed: int, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with their place ``__at`` (``by``, seeded key, id, row number) and the places alone with their rank ``__r``.

    The rows are written once, so that their numbers stay; only the places are sorted."""
    place = F.struct(*by, "__key", F.col(id).alias("__id"), F.monotonically_increasing_id().alias("__n"))
    rows = cut_lineage(df.withColumn("__key", seeded_key(id, seed)).withColumn("__at", place).drop("__key"))
    return rows, global_rank(rows.select("__at"), ["__at"], rank_col="__r")


def undersample(df: DataFrame, label: str = "label", seed: int = 0, id: str = "id") -> DataFrame:
    """Keep, for every class, as many rows as the smallest class has — the
    first ones in the seeded order.  Exact and distributed: a global rank over
    (label, key, id) minus each class's start offset gives the rank inside the
    class, so no class is ever sorted inside a single task.  The last place to keep of each
    class decides on the rows where they are: one row per class travels."""
    rows, ranked = _ordered(df, id, seed, [label])
    ranked = ranked.withColumn("__class", F.col("__at").getField(label))
    starts = ranked.groupBy("__class").agg(F.min("__r").alias("__start"), F.count(F.lit(1)).alias("__size"))
    smallest = starts.select(F.min("__size")).scalar()
    last = ranked.join(starts, "__class").filter(F.col("__r") - F.col("__start") < smallest)
    last = last.groupBy("__class").agg(F.max("__at").alias("__last"))
    out = rows.join(F.broadcast(last), F.col(label) == F.col("__class")).filter(F.col("__at") <= F.col("__last"))
    return out.select(label, *[c for c in df.columns if c != label])


def split(df: DataFrame, seed: int = 0, id: str = "id", test_fraction: float = 0.1) -> DataFrame:
    """Add ``split`` ∈ {train, test, valid}.  The held-out part is the first
    ``ceil(10 %)`` rows in the seeded order; its first ``ceil(half)`` rows are
    ``test`` and the rest ``valid``.  The last places of the two parts decide on the rows where they are."""
    rows, ranked = _ordered(df, id, seed, [])
    n = ranked.select(F.count(F.lit(1))).scalar()
    held = F.ceil(n * F.lit(test_fraction))
    test = F.ceil(held * F.lit(0.5))
    upto = lambda last: F.max(F.when(F.col("__r") <= last, F.col("__at")))
    ends = cut_lineage(ranked.agg(upto(test).alias("__test"), upto(held).alias("__held")))
    end = lambda part: ends.select(part).scalar()
    return rows.withColumn(
        "split",
        F.when(F.col("__at") <= end("__test"), "test").when(F.col("__at") <= end("__held"), "valid").otherwise("train"),
    ).drop("__at")


def confusion(df: DataFrame, y: str = "label", p: str = "predicted_label") -> DataFrame:
    """2×2 confusion counts ``(actual, predicted, n)``; absent cells are 0."""
    cells = df.select(F.col(y).alias("actual"), F.col(p).alias("predicted"))
    counts = cells.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame(
        [(a, b) for a in (0, 1) for b in (0, 1)], "actual int, predicted int"
    )
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce(F.col("n"), F.lit(0)).alias("n")
    )


def binary_metrics(df: DataFrame, y: str = "label", p: str = "predicted_label") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1 in one aggregate;
    F1 = TP / (TP + (FP + FN) / 2).  A zero denominator gives NULL."""
    tp = F.count_if((F.col(y) == 1) & (F.col(p) == 1))
    tn = F.count_if((F.col(y) == 0) & (F.col(p) == 0))
    fp = F.count_if((F.col(y) == 0) & (F.col(p) == 1))
    fn = F.count_if((F.col(y) == 1) & (F.col(p) == 0))
    c = df.agg(tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    tpc, tnc, fpc, fnc = (F.col(k).cast("double") for k in ("tp", "tn", "fp", "fn"))
    return c.select(
        "tp", "tn", "fp", "fn",
        F.try_divide(tpc + tnc, tpc + tnc + fpc + fnc).alias("accuracy"),
        F.try_divide(tpc, tpc + fpc).alias("precision"),
        F.try_divide(tpc, tpc + fnc).alias("recall"),
        F.try_divide(tpc, tpc + F.lit(0.5) * (fpc + fnc)).alias("f1"),
    )


def outcome(df: DataFrame, actual: str = "mentions_location", predicted: str = "has_location") -> DataFrame:
    """``blue`` = actual 1 and predicted, ``red`` = actual 0 and predicted,
    else NULL."""
    pred = F.col(predicted).cast("boolean")
    return df.withColumn(
        "outcome",
        F.when((F.col(actual) == 1) & pred, "blue").when((F.col(actual) == 0) & pred, "red"),
    )


def error_slices(df: DataFrame, actual: str = "mentions_location", predicted: str = "has_location") -> DataFrame:
    """F16: tag each row TP / TN / FP / FN (predicted = has a resolved place)."""
    a = F.col(actual) == 1
    p = F.col(predicted).cast("boolean")
    return df.withColumn(
        "slice",
        F.when(a & p, "TP").when(~a & ~p, "TN").when(~a & p, "FP").otherwise("FN"),
    )


def error_details(sliced: DataFrame, toponyms: DataFrame, id: str = "id") -> DataFrame:
    """F16: ``detail`` cuts the FN slice by whether the post has any toponym (resolved or not), and ``names`` holds
    the resolved names of each FP post in order (empty elsewhere).  ``toponyms(id, word, loc)`` is the long form;
    a post's names are bounded by its text."""
    per = toponyms.groupBy(F.col(id).alias("__tid")).agg(
        F.count("word").alias("n_toponyms"),
        F.array_sort(F.collect_set(F.when(F.col("loc.place_id").isNotNull(), F.col("word")))).alias("__names"),
    )
    out = sliced.join(per, sliced[id] == per["__tid"], "left")
    n = F.coalesce("n_toponyms", F.lit(0))
    detail = F.when(F.col("slice") != "FN", F.col("slice")).when(n > 0, "FN with toponyms").otherwise("FN without toponyms")
    names = F.when(F.col("slice") == "FP", F.coalesce("__names", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return out.select(*[sliced[c] for c in sliced.columns], n.cast("long").alias("n_toponyms"), detail.alias("detail"), names.alias("names"))


# ---------------------------------------------------------------------------
# MLlib pipeline (re-aims the transformer classifier)
# ---------------------------------------------------------------------------


def train(df: DataFrame, label: str = "label", tokens: str = "tokens", num_features: int = 1 << 18, reg: float = 0.01, max_iter: int = 50):
    """Tokens → HashingTF → IDF → logistic regression, fitted on ``df``.

    Hashing keeps the feature space fixed, so no vocabulary is collected to the
    driver; IDF and the optimiser are distributed aggregates.  ``label`` must
    be 0/1.  Every pass of the optimiser sends one gradient of ``num_features`` doubles per
    partition, so the rows are read in at most two partitions per core.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF

    few = 2 * df.sparkSession.sparkContext.defaultParallelism
    data = df.withColumn("__label", F.col(label).cast("double")).coalesce(few)
    pipe = Pipeline(
        stages=[
            HashingTF(inputCol=tokens, outputCol="__tf", numFeatures=num_features),
            IDF(inputCol="__tf", outputCol="__features"),
            LogisticRegression(
                featuresCol="__features", labelCol="__label", regParam=reg, maxIter=max_iter,
                probabilityCol="__prob", rawPredictionCol="__raw", predictionCol="__pred",
            ),
        ]
    )
    return pipe.fit(data)


def predict(df: DataFrame, model) -> DataFrame:
    """Every input column plus ``softmax`` (highest class probability) and
    ``predicted_label`` (its index)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    probs = vector_to_array(F.col("__prob"))
    return out.select(
        *[F.col(c) for c in df.columns],
        F.array_max(probs).alias("softmax"),
        F.col("__pred").cast("int").alias("predicted_label"),
        probs.alias("probability"),
    )


# Bytes of a batch that a model of the user's own sees at a time (one row at least); as Python objects some 20 times as much.
PIECE_BYTES = 2 << 20


def _pieces(batch: pa.Array) -> Iterator[pa.Array]:
    if batch.nbytes <= PIECE_BYTES or len(batch) <= 1:
        yield batch
    else:
        half = len(batch) // 2
        yield from _pieces(batch.slice(0, half))
        yield from _pieces(batch.slice(half))


def _frame(piece: pa.Array) -> pd.DataFrame:
    """A struct array as pandas, as Spark gives it to a pandas UDF: timestamps in the session's time zone without it, maps as dicts."""
    frame = pa.RecordBatch.from_struct_array(piece).to_pandas(maps_as_pydicts="lossy", coerce_temporal_nanoseconds=True)
    for name in frame.columns:
        if isinstance(frame[name].dtype, pd.DatetimeTZDtype):
            frame[name] = frame[name].dt.tz_localize(None)
    return frame


def predict_with(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], np.ndarray]], inputs: list[str]) -> DataFrame:
    """M18 with a model of the user's own: every input column plus ``softmax``, ``predicted_label`` and ``probability``.

    ``load()`` runs once per task, on the executor, and gives a function from rows of the columns
    ``inputs`` (pandas, ``PIECE_BYTES`` of Arrow data at most, so that memory does not follow the length of the rows) to the
    class probabilities, one row of the same number of classes for each row of the batch.  The
    lowest class wins a tie.  Columns of these three names are replaced.  An empty table gives no rows."""

    @F.arrow_udf("array<double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load()
        for batch in batches:
            for piece in _pieces(batch):
                frame = _frame(piece)
                p = np.asarray(model(frame), dtype="float64")
                if p.ndim != 2 or len(p) != len(frame):
                    raise ValueError(f"the model gave shape {p.shape} for {len(frame)} rows")
                ends = np.arange(len(p) + 1, dtype="int32") * p.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(p.reshape(-1)))

    names = ("softmax", "predicted_label", "probability")
    # Not deterministic for the optimizer, so that the model runs once per row and not once per use of its result.
    out = df.withColumn("__prob", score.asNondeterministic()(F.struct(*inputs)))
    best = F.array_max("__prob")
    return out.select(
        *[F.col(c) for c in df.columns if c not in names],
        best.alias("softmax"), (F.array_position("__prob", best) - 1).cast("int").alias("predicted_label"), F.col("__prob").alias("probability"),
    )


def murmur3(data: bytes, seed: int = 42) -> int:
    """MurmurHash3 x86 32-bit as a signed integer: the hash of MLlib's ``HashingTF``."""
    mask, h = 0xFFFFFFFF, seed

    def mixed(k):
        k = k * 0xCC9E2D51 & mask
        return ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & mask) * 5 + 0xE6546B64 & mask
    if whole < len(data):
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@functools.lru_cache(maxsize=1 << 16)
def _word_hash(word: str) -> int:
    return murmur3(word.encode())


class HashedLinear:
    """A fitted ``train`` pipeline as a plain function of token batches, for ``predict_with``; null tokens are none."""

    def __init__(self, weights: np.ndarray, intercept: float, tokens: str = "tokens"):
        self.weights, self.intercept, self.tokens = weights, intercept, tokens

    @classmethod
    def of(cls, model, tokens: str = "tokens") -> HashedLinear:
        """IDF and coefficients folded into one weight per hash slot, as many as ``train``'s ``num_features``."""
        _, idf, logistic = model.stages
        return cls(np.asarray(idf.idf.toArray()) * logistic.coefficients.toArray(), float(logistic.intercept), tokens)

    def __call__(self, batch: pd.DataFrame) -> np.ndarray:
        lists = [[] if x is None else x for x in batch[self.tokens]]
        row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        code, words = pd.factorize(np.array([w for x in lists for w in x], dtype=object))
        slot = np.array([_word_hash(w) % len(self.weights) for w in words], dtype="int64")
        margin = np.bincount(row, self.weights[slot][code], minlength=len(lists)) + self.intercept
        p = 1 / (1 + np.exp(-margin))
        return np.stack([1 - p, p], axis=1)


def with_loss(df: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """Per-row cross-entropy of the true label, ``-ln(p[label])``."""
    p = F.element_at(F.col(probability), F.col(label).cast("int") + 1)
    return df.withColumn("loss", -F.log(p))
