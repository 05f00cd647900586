"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ten consecutive item words (a shorter item is one window) is a
pattern over normalised text; the automaton reads each document's normalised
text once, and hits are mapped back to word numbers and, on request, to code
point offsets of the original text.

Null or empty texts, and texts or items without words, have no hits.  Repeated
document rows give repeated result rows; repeated items count once per item_id;
items with a null id are matched under the id ``""``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.llm.common import keep_rows

WINDOW = 10

#: Pattern text held by one automaton.  A larger benchmark is split by window
#: hash into as many automata as needed, each collected and broadcast on its own.
MAX_PATTERN_BYTES = 32 << 20
#: Document text that is held while several automata are run over it.
HELD_TEXT_BYTES = 64 << 20

#: Normalisation: A-Z to a-z; every other ASCII byte than 0-9 a-z ends a word.
_NORMAL = bytes(
    (b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, item_id) of every item, each pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wins, ids = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = normal_words(t)
                if w:
                    found = {b" ".join(w[k : k + WINDOW]) for k in range(max(1, len(w) - WINDOW + 1))}
                    wins += [x.decode() for x in found]
                    ids += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.string()), pa.array(ids, pa.string())], ["window", "item"])

    src = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    return src.mapInArrow(run, "window string, item string").distinct()


def pattern_chunks(windows: DataFrame, max_bytes: int = MAX_PATTERN_BYTES) -> list:
    """Broadcast lists of (window, item ids), each of bounded size.

    The size of all windows is measured first; window hashes then split them
    into chunks that the driver holds one at a time.
    """
    sc = windows.sparkSession.sparkContext
    size = windows.agg(F.sum(F.length("window") + F.length("item") + 64)).first()[0] or 0
    n = int(size // max_bytes) + 1
    out = []
    for k in range(n):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(n)) == k) if n > 1 else windows
        by: dict[str, list[str]] = {}
        for r in part.toLocalIterator():
            by.setdefault(r["window"], []).append(r["item"])
        out.append(sc.broadcast(sorted((w, sorted(i)) for w, i in by.items())))
    return out


def build_automaton(patterns: list):
    """Aho-Corasick over `` window ``; a pattern's value is its number and word count."""
    import ahocorasick

    a = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    for k, (w, _) in enumerate(patterns):
        a.add_word(f" {w} ", (k, w.count(" ") + 1))
    if len(a):
        a.make_automaton()
    return a


def scan(automaton, words: list[bytes]) -> tuple[np.ndarray, set[int]]:
    """Word intervals [start, end) hit by patterns, and the numbers of those patterns.

    One left-to-right pass over the normalised text; positions become word
    numbers through the blanks before them.
    """
    if not len(automaton) or not words:
        return np.zeros((0, 2), np.int64), set()
    text = (b" " + b" ".join(words) + b" ").decode("utf-8", "surrogatepass")
    ends, lens, pats = [], [], set()
    for end, (k, n) in automaton.iter(text):
        ends.append(end)
        lens.append(n)
        pats.add(k)
    if not ends:
        return np.zeros((0, 2), np.int64), pats
    blanks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") == 32)
    last = np.searchsorted(blanks, ends)  # the closing blank of word number last - 1
    return np.stack([last - np.asarray(lens), last], axis=1), pats


def hit_mask(n_words: int, spans: np.ndarray) -> np.ndarray:
    edge = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    return np.cumsum(edge)[:n_words] > 0


def original_spans(text: str, mask: np.ndarray) -> str:
    """Code point ranges of runs of hit words in the original text, ``start:end`` comma-joined."""
    at = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return ",".join(f"{at[a][0]}:{at[b - 1][1]}" for a, b in zip(edge[::2], edge[1::2]))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    max_bytes: int = MAX_PATTERN_BYTES,
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_spans.

    Map-only over the documents.  With one automaton (the usual case) texts
    stream through it; with several, a bounded stretch of documents is held
    while the automata are run over it one after the other.
    """
    chunks = pattern_chunks(item_windows(benchmark), max_bytes)

    def scanned(batches: Iterator[pa.RecordBatch]):
        """(ids, texts, words, per text: spans and item ids)."""
        single = build_automaton(chunks[0].value) if len(chunks) == 1 else None
        held: list[pa.RecordBatch] = []
        size = 0

        def flush():
            ids = [i for b in held for i in b.column(0).to_pylist()]
            texts = [t for b in held for t in b.column(1).to_pylist()]
            words = [normal_words(t) for t in texts]
            spans = [[] for _ in ids]
            items: list[set] = [set() for _ in ids]
            for c in chunks:
                a = single if single is not None else build_automaton(c.value)
                for k, w in enumerate(words):
                    s, pats = scan(a, w)
                    if len(s):
                        spans[k].append(s)
                        for p in pats:
                            items[k].update(c.value[p][1])
            return ids, texts, words, spans, items

        for b in batches:
            held.append(b)
            size += b.nbytes
            if single is not None or size >= HELD_TEXT_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    id_type = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, words, spans, items in scanned(batches):
            n_hit, where = [], []
            for t, w, s in zip(texts, words, spans):
                if not s:
                    n_hit.append(0)
                    where.append("")
                    continue
                mask = hit_mask(len(w), np.concatenate(s))
                n_hit.append(int(mask.sum()))
                where.append(original_spans(t, mask))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, arrow_id),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(i) for i in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                    pa.array(where, pa.string()),
                ],
                [doc_id, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)
    schema = T.StructType(
        [
            T.StructField(doc_id, id_type),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()),
            T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()),
            T.StructField("hit_spans", T.StringType()),
        ]
    )
    return docs.select(doc_id, text).mapInArrow(run, schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a window of any item."""
    chunks = pattern_chunks(item_windows(benchmark), max_bytes)
    kept: list = []

    def automata():
        if len(chunks) > 1:
            return (build_automaton(c.value) for c in chunks)
        if not kept:
            kept.append(build_automaton(chunks[0].value))
        return kept

    def rejects(column: pa.Array) -> np.ndarray:
        words = [normal_words(t) for t in column.to_pylist()]
        hit = np.zeros(len(words), dtype=bool)
        for a in automata():
            for i in np.flatnonzero(~hit):
                hit[i] = bool(scan(a, words[i])[1])
        return hit

    return keep_rows(docs, text, rejects)


def _sql_words(column: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '')"


#: DuckDB restatement of the contract's columns.
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce({_sql_words("text")}, []) AS w FROM documents),
it AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, {_sql_words("text")} AS w FROM benchmark),
iw AS (
    SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win
    FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: w[i:i + 9])) AS win
          FROM it WHERE len(w) > 0)
),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, ns WHERE len(w) >= n
),
hits AS (
    SELECT DISTINCT doc_id, p, iw.n, item_id
    FROM (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM dw) x JOIN iw USING (n, win)
),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
its AS (
    SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
