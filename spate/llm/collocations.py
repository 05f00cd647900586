"""Phrase collocations from sorted count streams.

Texts are lower-cased (A-Z only) and cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces
into words ``[^\\x20\\x09]+``.  All counts are per language (null: ``und``).

1. Three scans write count streams of one, two, and three to four words.  A task
   sorts the windows of a slice of texts and sends each different one once, with its
   count; Spark adds them up.  A phrase with ``least`` occurrences consists of
   phrases that have as many, so scan two leaves out windows over rarer words and
   scan three those over rarer pairs.  Bit maps of fixed size stand for the frequent
   words and pairs of a scan: a false positive costs room, never a count.
   The last scan writes one window a position (four words, or three where the next
   one cannot belong); the counts of three words are sums over the windows that
   begin with them.
2. The frequent phrases are kept as one stream.  Its *prefix order* holds each
   candidate under each of its beginnings, its *suffix order* under each of its
   endings.  Both are sorted by Spark and merged in lockstep with the stream of
   counts (sort-merge joins, no hash tables): the counts of the left and right part
   of each cut come from the two orders.
3. Extension counts come from the same two orders: a candidate of m words is an
   extension of its first and of its last m - 1 words, and the largest extension of
   each phrase is merged back.  One word more is enough: a phrase of two words
   inside one of four also lies in one of three between them, which is at least as
   frequent as that of four and so a candidate too.
4. The first ``top`` phrases of a language: ranks inside groups of bounded size, in
   rounds, so that no task gets all phrases of a language.

Null and empty texts have no words; repeated rows and ids count as often as they
occur; no id is read.  Ties in a score are ordered by count, then by the phrase's
UTF-8 bytes.  Other columns of ``docs`` are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spate.llm.common import FOLD, TextBatch, Words, mix64, slices, stage

LEAST = 30
LONGEST = 4
TOP = 2_000
#: A candidate goes when a longer one has at least this share (per cent) of its occurrences.
ABSORBED = 80
SCALE = 2_000_000
#: Bits of the map of frequent words or pairs (4 MB on the driver and in a broadcast, at every size).
MAP_BITS = 1 << 25
MAP_HASHES = 2
#: Text bytes of one numpy pass.
SLICE = 1 << 20
#: Rows that one group of the ranking holds, about.
RANK_ROWS = 20_000

_PIECE_END = np.zeros(256, dtype=bool)
_PIECE_END[[*b".,;:!?", 10, 11, 12, 13]] = True
_IN_WORD = ~_PIECE_END
_IN_WORD[[32, 9]] = False
_NOT_SPACE = np.ones(256, dtype=bool)
_NOT_SPACE[32] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STREAM = "lang string, phrase string, c long"


class Windows:
    """The words of a slice of texts in order: number of each one's (language, word), and which pairs adjoin."""

    def __init__(self, lang: pa.Array, text: pa.Array):
        tb = TextBatch(text)
        data, off = tb.data, tb.offsets
        inside = _IN_WORD[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = off[1:-1][off[1:-1] < len(data)]
        first[cuts] |= inside[cuts]
        start = np.flatnonzero(first).astype(np.int64)
        self.n = len(start)
        codes = pc.fill_null(lang.cast(pa.string()), "und").dictionary_encode()
        self.langs = codes.dictionary
        if not self.n:
            return
        length = np.add.reduceat(inside, start, dtype=np.int32)
        ends = np.add.reduceat(_PIECE_END[data], start, dtype=np.int32)
        doc = np.searchsorted(off[1:], start, side="right")
        self.adjoin = (ends[:-1] == 0) & (doc[1:] == doc[:-1])
        at = np.zeros(self.n + 1, dtype=np.int32)
        np.cumsum(length, out=at[1:])
        words = pa.Array.from_buffers(
            pa.string(), self.n, [None, pa.py_buffer(at), pa.py_buffer(FOLD[data[inside]])]
        ).dictionary_encode()
        self.words = words.dictionary
        key = codes.indices.to_numpy()[doc].astype(np.int64) * len(self.words) + words.indices.to_numpy()
        self.key, self.no, self.count = np.unique(key, return_inverse=True, return_counts=True)

    def lang(self, no: np.ndarray) -> pa.Array:
        return self.langs.take(pa.array(self.key[no] // len(self.words)))

    def word(self, no: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        return self.words.take(pa.array(self.key[no] % len(self.words), mask=missing))

    def hashes(self) -> np.ndarray:
        """Hash of each (language, word)."""
        one, two = word_hashes(self.langs), word_hashes(self.words)
        return joined(one[self.key // len(self.words)], two[self.key % len(self.words)])


def word_hashes(strings: pa.Array) -> np.ndarray:
    """64-bit hash of each string of at least one byte (0 for empty ones)."""
    tb = TextBatch(strings)
    w = Words(tb, False, np.ones(256, dtype=bool), ())
    out = np.zeros(tb.n, dtype=np.uint64)
    out[w.doc] = w.hash
    return out


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * _STEP + b)


def map_positions(h: np.ndarray) -> np.ndarray:
    """Positions (rows x MAP_HASHES) of hashes in the bit map."""
    bits = np.uint64(MAP_BITS - 1)
    return np.stack([(h >> np.uint64(27 * k)) & bits for k in range(MAP_HASHES)], axis=1).astype(np.int64)


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = map_positions(h)
    return ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)


def phrase_map(frequent: DataFrame, n_words: int) -> np.ndarray:
    """Bit map of the phrases (lang, phrase) of one or two words; 512K numbers of 64 bits, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                w = Words(TextBatch(batch.column(1)), False, _NOT_SPACE, ())
                lang = word_hashes(batch.column(0))
                at = w.doc_off[:-1]
                h = joined(lang, w.hash[at])
                if n_words == 2:
                    h = joined(h, joined(lang, w.hash[at + 1]))
                yield pa.RecordBatch.from_arrays([pa.array(map_positions(h).ravel())], ["p"])

    pos = frequent.select("lang", "phrase").mapInArrow(run, "p long")
    cell = pos.groupBy(F.shiftright("p", 6).cast("int").alias("i")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")
    )
    got = cell.toArrow()
    out = np.zeros(MAP_BITS >> 6, dtype=np.uint64)
    out[got.column("i").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _scan(docs: DataFrame, lang: str, text: str, emit) -> DataFrame:
    """Sum of the windows that ``emit`` finds in each slice: (lang, phrase, c)."""
    limit = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, limit):
                w = Windows(part.column(0), part.column(1))
                if w.n:
                    for columns in emit(w):
                        yield pa.RecordBatch.from_arrays([columns[0], columns[1], pa.array(columns[2], pa.int64())], ["lang", "phrase", "c"])

    src = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, _STREAM).groupBy("lang", "phrase").agg(F.sum("c").alias("c"))


def _single(w: Windows):
    every = np.arange(len(w.key))
    yield w.lang(every), w.word(every), w.count
    # The phrase without words holds the language's number of words.
    code, where = np.unique(w.key // len(w.words), return_inverse=True)
    total = np.bincount(where, weights=w.count).astype(np.int64)
    yield w.langs.take(pa.array(code)), pa.array([""] * len(code), pa.string()), total


def _pairs(bits):
    def emit(w: Windows):
        ok = in_map(bits.value, w.hashes())[w.no]
        at = np.flatnonzero(w.adjoin & ok[:-1] & ok[1:])
        if len(at):
            pair, count = np.unique(w.no[at] * len(w.key) + w.no[at + 1], return_counts=True)
            a, b = pair // len(w.key), pair % len(w.key)
            yield w.lang(a), pc.binary_join_element_wise(w.word(a), w.word(b), " "), count

    return emit


def _longer(bits):
    def emit(w: Windows):
        h = w.hashes()
        at = np.flatnonzero(w.adjoin)
        pair, no = np.unique(w.no[at] * len(w.key) + w.no[at + 1], return_inverse=True)
        a, b = pair // len(w.key), pair % len(w.key)
        number = np.full(w.n + 2, -1, dtype=np.int64)  # of the frequent pair that begins at a word
        number[at] = np.where(in_map(bits.value, joined(h[a], h[b])) if len(pair) else False, np.arange(len(pair)), -1)[no]
        begin = np.flatnonzero((number[:-2] >= 0) & (number[1:-1] >= 0))
        if not len(begin):
            return
        rest = np.where(number[begin + 2] >= 0, len(w.key) + number[begin + 2], w.no[np.minimum(begin + 2, w.n - 1)])
        width = len(w.key) + len(pair)
        window, count = np.unique(number[begin] * width + rest, return_counts=True)
        one, rest = window // width, window % width
        four = rest >= len(w.key)
        two = np.where(four, rest - len(w.key), 0)
        third, fourth = np.where(four, a[two], rest), np.where(four, b[two], 0)
        text = pc.binary_join_element_wise(
            w.word(a[one]), w.word(b[one]), w.word(third), w.word(fourth, ~four), " ", null_handling="skip"
        )
        yield w.lang(a[one]), text, count

    return emit


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, m, f) of every phrase of one to four words with ``least`` occurrences, and (lang, n) of all words."""
    sc = docs.sparkSession.sparkContext
    enough = F.col("c") >= least
    single = stage(_scan(docs, lang, text, _single).filter(enough | (F.col("phrase") == "")), "colloc-1")
    one = single.filter(enough & (F.col("phrase") != ""))
    two = stage(_scan(docs, lang, text, _pairs(sc.broadcast(phrase_map(one, 1)))).filter(enough), "colloc-2")
    windows = stage(_scan(docs, lang, text, _longer(sc.broadcast(phrase_map(two, 2)))), "colloc-windows")
    three = windows.groupBy("lang", F.substring_index("phrase", " ", 3).alias("phrase")).agg(F.sum("c").alias("c")).filter(enough)
    four = windows.filter(enough & (F.size(F.split("phrase", " ")) == LONGEST))
    counts = None
    for m, df in enumerate((one, two, three, four), start=1):
        part = df.select("lang", "phrase", F.lit(m).alias("m"), F.col("c").alias("f"))
        counts = part if counts is None else counts.unionByName(part)
    total = single.filter("phrase = ''").select("lang", F.col("c").alias("n"))
    return stage(counts, "colloc-counts"), total


def _order(candidates: DataFrame, suffix: bool) -> DataFrame:
    """Each candidate under each of its proper beginnings (or endings), with the cut k before which the beginning ends."""
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    words = F.split("phrase", " ")
    part = F.slice(words, F.col("k") + 1, F.col("m") - F.col("k")) if suffix else F.slice(words, F.lit(1), F.col("k"))
    return cut.select("lang", "phrase", "m", "a", "k", F.array_join(part, " ").alias("part"))


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED
) -> DataFrame:
    """Per language the ``top`` phrases: lang, rank, phrase, a, l, r, n, score (see the module)."""
    counts, total = phrase_counts(docs, lang, text, least)
    candidates = counts.filter("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"))
    stream = counts.select("lang", F.col("phrase").alias("part"), "f")
    prefix, suffix = _order(candidates, False), _order(candidates, True)
    left = prefix.join(stream.withColumnRenamed("f", "l").hint("merge"), ["lang", "part"]).drop("part")
    right = suffix.join(stream.withColumnRenamed("f", "r").hint("merge"), ["lang", "part"]).select("lang", "phrase", "k", "r")
    cuts = left.join(right.hint("merge"), ["lang", "phrase", "k"]).withColumn(
        "score", F.expr(f"cast({SCALE} as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    )
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.score", "x.l", "x.r")
    # The two orders again: one word more on the right, one word more on the left.
    grown = prefix.filter("k = m - 1").unionByName(suffix.filter("k = 1")).groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("most"))
    kept = best.join(grown.hint("merge"), ["lang", "phrase"], "left").filter(
        F.expr(f"most is null or cast(100 as decimal(3,0)) * cast(most as decimal(19,0)) < cast({absorbed} as decimal(3,0)) * cast(a as decimal(19,0))")
    )
    kept = stage(kept.drop("most"), "colloc-kept")
    first = first_of_each(kept, top)
    return first.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def first_of_each(kept: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each language with their rank; groups of about RANK_ROWS rows are cut to ``top`` first, in rounds."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    groups = -(-kept.count() // max(RANK_ROWS, 2 * top))
    while groups > 1:
        by = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(groups))).orderBy(*order)
        kept = kept.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).drop("rank")
        groups = -(-groups * top // max(RANK_ROWS, 2 * top))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


#: The same result in DuckDB SQL, from all windows of one to four words.
ORACLE_SQL = r"""
WITH src AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]') AS pieces
    FROM documents),
piece AS (SELECT d, lang, unnest(pieces) AS piece, unnest(range(len(pieces))) AS p FROM src),
listed AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM piece),
gram AS (
    SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
    FROM listed, range(1, 5) t(m), unnest(range(1, len(w) + 2 - m)) u(i)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM gram GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cut AS (
    SELECT c.lang, c.phrase, c.m, c.a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a // (l.f + r.f))::BIGINT AS score
    FROM cand c, range(1, 4) t(k)
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.w, k + 1, c.m), ' ')
    WHERE k < c.m),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrase AS (
    SELECT c.lang, c.a, array_to_string(list_slice(c.w, i, i + s - 1), ' ') AS phrase
    FROM cand c, range(2, 4) t(s), unnest(range(1, c.m + 2 - s)) u(i) WHERE s < c.m),
grown AS (SELECT lang, phrase, max(a) AS most FROM inner_phrase GROUP BY ALL),
kept AS (
    SELECT b.* FROM best b LEFT JOIN grown g USING (lang, phrase)
    WHERE g.most IS NULL OR 100::HUGEINT * g.most < 80::HUGEINT * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
