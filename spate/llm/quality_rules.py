"""Quality rules: plain counts, and the perplexity of a modified Kneser-Ney n-gram model of the document's language.

Each language has a model of its own.  It is over the whole text, written in 64 symbols without loss: a byte of
UTF-8 is one symbol or an escape and one symbol, so that texts that differ have
different symbols and the model's probability is that of the text itself.  The
n-grams are of order 4, so a model has at most 64**4 entries however
large the corpus is.  Languages whose models have more than that together are
fitted and measured in turn; that is the proven bound of a broadcast.  Spark
counts the n-grams of all documents; the driver turns the summed counts into
sorted arrays of n-gram codes with their log-probabilities and backoff weights.

A document outside one of its language's bands is rejected: those of
log-perplexity and of word length, and the upper ends of those of the share of
symbols and of repeated lines.  Bands come from exact quartiles of all documents
of the language that pass the plain rules: [q1 - width * iqr, q3 + width * iqr].

Null texts have no words (all counts 0, ``base_failed``); a null language is a
language of its own.  Repeated rows give repeated rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.llm.common import WORD_BYTES, TextBatch, mix64, slices, stage

ORDER = 4
SYMBOLS = 64
_BITS = 6
BAND_WIDTH = 3.0
#: Narrowest half of a band: nats a byte, logarithm of the mean word length, share of the words' characters, share of the lines.
BAND_LEAST = {"log_ppl": 0.1, "log_length": 0.5, "symbol_share": 0.1, "dup_line_share": 0.3}
#: Measures that no document has too little of.
_UPPER_ONLY = ("symbol_share", "dup_line_share")
_BINS = 1000


#: ASCII characters and lead bytes that are one symbol; a text starts as if after a line end.
_SINGLE = b"abcdefghijklmnopqrstuvwxyz0123456789 \n.,;:!?'\"()-" + bytes([0xC3, 0xC4, 0xD0, 0xD1, 0xE2, 0xE3, *range(0xE4, 0xEA)])
_PAD = _SINGLE.index(b"\n")
_NONE = 255


def _symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """A byte's symbol, and the symbol after it if that is an escape (else ``_NONE``).

    What may begin a character is one of ``_SINGLE``, or 61 and a capital letter, 62 and another ASCII character, 63 and
    another byte.  A continuation byte follows its lead byte only, so all 64 symbols are its own: its six bits."""
    first, second = np.zeros(256, dtype=np.uint32), np.full(256, _NONE, dtype=np.uint32)
    first[list(_SINGLE)] = np.arange(len(_SINGLE))
    first[128:192] = np.arange(64)
    upper = range(65, 91)
    ascii_rest = [b for b in range(128) if b not in _SINGLE and b not in upper]
    for escape, rest in ((61, upper), (62, ascii_rest), (63, [b for b in range(192, 256) if b not in _SINGLE])):
        first[list(rest)] = escape
        second[list(rest)] = np.arange(len(rest))
    return first, second


_FIRST, _SECOND = _symbol_table()
#: Characters that count as symbols (fixed value of the contract).
_ODD = np.zeros(256, dtype=bool)
_ODD[[ord(c) for c in "#*$%&|<>"]] = True


def coded(batch: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """The order-4 code that ends at each symbol, document starts padded, and where each document's symbols begin and end."""
    pad = ORDER - 1
    two = _SECOND[batch.data] != _NONE
    end = np.cumsum(1 + two)
    bounds = np.concatenate(([0], end))[batch.offsets]
    plain = np.empty(bounds[-1], dtype=np.uint32)
    plain[end - 1 - two] = _FIRST[batch.data]
    plain[end[two] - 1] = _SECOND[batch.data[two]]
    sym = np.full(len(plain) + pad * batch.n, _PAD, dtype=np.uint32)
    at = np.arange(len(plain)) + np.repeat(pad * np.arange(1, batch.n + 1), np.diff(bounds))
    sym[at] = plain
    out = plain
    for k in range(1, ORDER):
        out |= sym[at - k] << np.uint32(_BITS * k)
    return out, bounds


def codes(batch: TextBatch) -> np.ndarray:
    """The order-4 code that ends at each symbol."""
    return coded(batch)[0]


def by_language(batch: pa.RecordBatch, lang_at: int) -> Iterator[tuple[str | None, pa.RecordBatch]]:
    """The rows of each language of a batch; null is a language."""
    column = batch.column(lang_at).cast(pa.string()).dictionary_encode(null_encoding="encode")
    number = column.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(number, kind="stable")
    ends = np.cumsum(np.bincount(number, minlength=len(column.dictionary)))
    for i, name in enumerate(column.dictionary.to_pylist()):
        yield name, batch.take(pa.array(order[ends[i - 1] if i else 0 : ends[i]]))


def ngram_counts(docs: DataFrame, text: str, lang: str = "lang") -> DataFrame:
    """(lang, code, n) over all documents: counted per slice, summed by Spark."""

    def merged(held):
        c, n = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        u, inv = np.unique(c, return_inverse=True)
        return u, np.bincount(inv, weights=n, minlength=len(u)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for name, rows in by_language(batch, 1):
                own = held.setdefault(name, [])
                for part in slices(rows, 0):
                    own.append(np.unique(codes(TextBatch(part.column(0))), return_counts=True))
                    if len(own) >= 8:
                        own[:] = [merged(own)]
        for name, own in held.items():
            u, n = merged(own)
            for k in range(0, len(u), 100_000):
                u_, n_ = u[k : k + 100_000].astype(np.int32), n[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u_), pa.string()), pa.array(u_), pa.array(n_)], ["lang", "code", "n"])

    rows = docs.select(text, F.col(lang).cast("string").alias("lang"))
    return rows.mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class KneserNey:
    """Interpolated modified Kneser-Ney over packed codes, as sorted arrays per order."""

    def __init__(self, code: np.ndarray, count: np.ndarray):
        order = np.argsort(code)
        code, count = code[order].astype(np.uint32), count[order].astype(np.int64)
        tables = [(code, count)]
        for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left extensions
            tables.insert(0, np.unique(tables[0][0] & np.uint32((1 << _BITS * k) - 1), return_counts=True))
        self.code: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.context: list[np.ndarray] = []
        self.backoff: list[np.ndarray] = []
        lower = None
        for k, (c, n) in enumerate(tables, start=1):
            d = self._discounts(n)
            ctx, inv = np.unique(c >> np.uint32(_BITS), return_inverse=True)
            total = np.bincount(inv, weights=n, minlength=len(ctx))
            less = d[np.minimum(n, 3)]
            left = np.bincount(inv, weights=less, minlength=len(ctx)) / np.maximum(total, 1)
            below = 1.0 / SYMBOLS if lower is None else lower[np.searchsorted(self.code[-1], c & np.uint32((1 << _BITS * (k - 1)) - 1))]
            p = (n - less) / total[inv] + left[inv] * below
            self.code.append(c)
            self.logp.append(np.log(p))
            self.context.append(ctx)
            self.backoff.append(np.log(np.maximum(left, 1e-12)))
            lower = p

    @staticmethod
    def _discounts(n: np.ndarray) -> np.ndarray:
        """[0, D1, D2, D3+] from counts of counts; the usual fall-back where one of them is empty."""
        n1, n2, n3, n4 = (int((n == k).sum()) for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            return np.array([0, 0.5, 0.75, 0.9])
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        return np.array([0, *(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))])

    def score(self, c: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each order-4 code given the others."""
        out = np.zeros(len(c))
        todo = np.arange(len(c))
        for k in range(ORDER, 0, -1):
            if not len(todo):
                break
            x = c[todo] & np.uint32((1 << _BITS * k) - 1) if k < ORDER else c[todo]
            table = self.code[k - 1]
            i = np.minimum(np.searchsorted(table, x), max(len(table) - 1, 0))
            hit = table[i] == x if len(table) else np.zeros(len(x), bool)
            out[todo[hit]] += self.logp[k - 1][i[hit]]
            todo, x = todo[~hit], x[~hit]
            if len(todo) and len(table):
                ctx = self.context[k - 1]
                i = np.minimum(np.searchsorted(ctx, x >> np.uint32(_BITS)), len(ctx) - 1)
                seen = ctx[i] == x >> np.uint32(_BITS)
                out[todo[seen]] += self.backoff[k - 1][i[seen]]
        out[todo] -= np.log(SYMBOLS)
        return out


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them are equal to an earlier line."""
    if b"\n" not in text:
        return int(bool(text.strip())), 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def plain_counts(batch: TextBatch) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words per document."""
    data, off = batch.data, batch.offsets
    w = batch.words(fold=False)
    gram, at = w.ngrams(3)
    repeat = np.zeros(len(w.doc), dtype=bool)
    if len(gram):
        key = mix64(gram + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        s = np.sort(key)
        twice = np.unique(s[1:][s[1:] == s[:-1]])
        if len(twice):
            i = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            first = at[twice[i] == key]
            for k in range(3):
                repeat[first + k] = True
    lines = np.array([line_counts(batch.text(i)) for i in range(batch.n)], dtype=np.int64).reshape(-1, 2)
    return {
        "n_words": w.per_doc,
        "word_chars": _per_doc(WORD_BYTES[data] & ((data & 0xC0) != 0x80), off),
        "n_symbols": _per_doc(_ODD[data], off),
        "n_lines": lines[:, 0],
        "n_dup_lines": lines[:, 1],
        "n_repeat_words": np.bincount(w.doc[repeat], minlength=batch.n).astype(np.int64),
    }


def turns(sizes: dict[str | None, int], most: int = SYMBOLS**ORDER) -> list[list[str | None]]:
    """The languages in groups whose models have at most ``most`` entries together (or one language)."""
    out, room = [], 0
    for name in sorted(sizes, key=lambda x: (-sizes[x], x is None, x or "")):
        if not out or sizes[name] > room:
            out.append([])
            room = most
        out[-1].append(name)
        room -= sizes[name]
    return out


def among(lang, names: list[str | None]):
    """Whether a column of languages is one of ``names``, of which one may be null."""
    known = F.coalesce(lang.isin([x for x in names if x is not None]), F.lit(False))
    return known | lang.isNull() if None in names else known


def fit(counts: DataFrame, names: list[str | None]) -> dict[str | None, KneserNey]:
    """A model for each of the languages from (lang, code, n); at most 64**4 rows of a turn come to the driver."""
    got = counts.filter(among(F.col("lang"), names)).select("lang", "code", "n").toArrow()
    column = got.column("lang").combine_chunks().dictionary_encode(null_encoding="encode")
    number, code, n = column.indices.to_numpy(zero_copy_only=False), got.column("code").to_numpy(), got.column("n").to_numpy()
    return {x: KneserNey(code[number == i], n[number == i]) for i, x in enumerate(column.dictionary.to_pylist())}


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MEASURED = [*COUNTS, "n_lines"]


def measure(docs: DataFrame, model: KneserNey | dict[str | None, KneserNey], doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, the plain counts, the lines with a word, and ``log_ppl`` (negative log-probability per byte; null
    without text) by the model, or by that of the document's language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [docs.schema[doc_id], T.StructField("lang", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in _MEASURED]
        + [T.StructField("log_ppl", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            for name, rows in by_language(batch, 1):
                own = models if isinstance(models, KneserNey) else models.get(name)
                for part in slices(rows, 2):
                    tb = TextBatch(part.column(2))
                    got = plain_counts(tb)
                    size = np.diff(tb.offsets)
                    code, bounds = coded(tb)
                    # Without a model there is no text in the language.
                    total = np.concatenate(([0.0], np.cumsum(own.score(code) if own else np.zeros(len(code)))))
                    loss = -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, 1)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), *(pa.array(got[n]) for n in _MEASURED), pa.array(loss, mask=size == 0)],
                        [doc_id, "lang", *_MEASURED, "log_ppl"],
                    )

    return docs.select(F.col(doc_id), F.col(lang).cast("string").alias("lang"), F.col(text)).mapInArrow(run, schema)


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def measures() -> dict:
    """What the bands are of, from the columns of ``measure``; null without words."""
    share = lambda n, of: F.when(F.col(of) > 0, F.col(n) / F.col(of))
    return {
        "log_ppl": F.col("log_ppl"),
        "log_length": F.when(F.col("n_words") > 0, F.log(F.col("word_chars") / F.col("n_words"))),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
    }


def bands(measured: DataFrame, width: float = BAND_WIDTH) -> DataFrame:
    """(band_lang, measure_lower, measure_upper of every measure): exact quartiles of the binned measure over all documents
    that pass the plain rules."""
    ok = measured.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    each = F.array(*[F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in measures().items()])
    long = ok.select("lang", F.explode(each).alias("m")).select("lang", "m.name", "m.value").filter("value is not null")
    bins = long.groupBy("lang", "name", F.floor(F.col("value") * _BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # At most some thousand bins a language and measure: a window over them is small.
    by = Window.partitionBy("lang", "name")
    run = bins.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    q = lambda f: F.min(F.when(F.col("upto") >= f * F.col("all"), F.col("bin"))) / _BINS
    found = run.groupBy("lang", "name").agg(q(0.25).alias("q1"), q(0.75).alias("q3"))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in BAND_LEAST.items() for x in kv]), F.col("name"))
    reach = F.greatest(least, width * (F.col("q3") - F.col("q1")))
    ends = found.select("lang", "name", (F.col("q1") - reach).alias("lower"), (F.col("q3") + reach).alias("upper"))
    at = lambda k, end: F.max(F.when(F.col("name") == k, F.col(end))).alias(f"{k}_{end}")
    return ends.groupBy(F.col("lang").alias("band_lang")).agg(*[at(k, end) for k in BAND_LEAST for end in ("lower", "upper")])


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", width: float = BAND_WIDTH) -> DataFrame:
    """Per document row: doc_id, the plain counts, base_failed, kept, log_ppl."""
    counts = stage(ngram_counts(docs, text, lang), "quality-ngrams")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    groups = turns(sizes) or [[]]
    parts = []
    for i, names in enumerate(groups):
        # What no turn names has no text: it goes with the last one.
        others = [x for g in groups[:-1] for x in g]
        own = ~among(F.col(lang).cast("string"), others) if i == len(groups) - 1 else among(F.col(lang).cast("string"), names)
        rows = docs.filter(own) if len(groups) > 1 else docs
        parts.append(stage(measure(rows, fit(counts, names), doc_id, text, lang), "quality-rules"))
    measured = functools.reduce(DataFrame.unionAll, parts)
    own = bands(measured, width)
    out = measured.join(own, measured["lang"].eqNullSafe(own["band_lang"]), "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    inside = F.lit(True)
    for k, v in measures().items():
        inside = inside & ((v <= F.col(f"{k}_upper")) if k in _UPPER_ONLY else v.between(F.col(f"{k}_lower"), F.col(f"{k}_upper")))
    return out.select(doc_id, *COUNTS, failed.alias("base_failed"), F.coalesce(~failed & inside, F.lit(False)).alias("kept"), "log_ppl")
