"""Secrets by fixed patterns and by the guess cost of values in a credential context.

*Base spans* are the matches of three fixed patterns (assign, access, hex).

*Method.*  After a credential word (password, pwd, token, ...) and ``:``, ``=``, ``->`` or
``is`` stands a value: in quotes (at most 256 bytes, spaces allowed), else up to a
space, quote, comma, semicolon or angle bracket, without punctuation at its end.  Its
guess cost is the least sum, over all ways to cut it into segments, of log10 of the
guesses for each segment and of the choice among the kinds of segments:

========  ======================================================================
word      rank of the word, times ways of capitals, times 2 a replaced letter
date      days times years from ``YEAR``, times 4 with separators
repeat    cost of the unit, times the repetitions
walk      keys x length x choices at each turn, along neighbouring keys
brute     size of the class of each character
========  ======================================================================

The dictionary is the corpus: words of 3 to 24 letters, the values themselves left
out, counted over all texts; the rank of a word is the number of words that are as
frequent or more so, among those that occur ``WORD_LEAST`` times.  Replaced letters (0 for o,
@ for a, ...) may be a third of a word.  Values of at least ``LEAST_LENGTH`` characters with a cost of
``THRESHOLD`` or more are spans of kind ``cost``, unless they lie inside a base span.

1. One scan finds base spans and values; a second counts words.
2. Each different value is looked at once: its substrings are joined with the word
   counts, and one linear pass over the value's characters finds the cheapest cut.
3. The costs are joined back to the places of the values.

Null and empty texts have no spans.  Null and repeated ids, and repeated rows, are
rows like others: each gives one row.  Ties between cuts go to the longer brute-force
span, then to the earlier listed kind.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.llm.common import FOLD, TextBatch, slices, stage

KINDS = ("assign", "access", "hex", "cost")
#: log10 of the guesses from which a value counts as a secret.
THRESHOLD = 10.0
LEAST_LENGTH = 6
WORD_LEAST = 2
WORD_SHORT, WORD_LONG = 3, 24
#: Longest unit of a repeat.
UNIT_LONG = 24
#: Dates are guessed from this year on, in both directions.
YEAR, YEARS_LEAST = 2020, 20
SLICE = 1 << 20

# The base patterns.
_KEYWORD = re.compile(rb"password|passwd|secret|token|api_?key")
_ASSIGN_REST = re.compile(rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_LEAST = 6

_CONTEXT = re.compile(rb"password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|credential")
_VALUE = re.compile(
    rb"""(?:["']?\x20*(?:[:=]>?|->)\x20*|s?\x20+is:?\x20+)(?:"([^"\n]{1,256})"|'([^'\n]{1,256})'|["']?([^\x00-\x20"'`,;<>]+))"""
)
_VALUE_END = b".:!?)]}"

#: Letters that stand for others.
REPLACED = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Rows of a keyboard; each row is shifted by half a key against the one above.
KEY_ROWS = ("`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./")
KEY_SHIFT = (0.0, 0.5, 0.75, 1.25)

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


# ---------------------------------------------------------------------------
# Places in the texts
# ---------------------------------------------------------------------------


def base_spans(raw: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes; ``low`` is ``raw`` with A-Z lower-cased."""
    out, end = [], 0
    for k in _KEYWORD.finditer(low):
        if k.start() >= end and (m := _ASSIGN_REST.match(raw, k.end())):
            end = m.end()
            if end - m.start(1) >= ASSIGN_LEAST:
                out.append((0, k.start(), end))
    out += [(1, *m.span()) for m in _ACCESS.finditer(raw)]
    out += [(2, *m.span()) for m in _HEX.finditer(raw)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def value_spans(raw: bytes, low: bytes) -> list[tuple[int, int]]:
    """(start, end) in bytes of the values in a credential context."""
    out, end = [], 0
    for k in _CONTEXT.finditer(low):
        if k.start() >= end and (m := _VALUE.match(raw, k.end())):
            a, end = m.span(m.lastindex)
            if m.lastindex == 3:
                end = a + len(raw[a:end].rstrip(_VALUE_END))
            if end > a:
                out.append((a, end))
    return out


_FOUND = "base array<struct<kind:int,start:int,end:int>>, vals array<struct<start:int,end:int,value:string>>"


def found_spans(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, base, vals) per row, offsets in code points."""
    schema = T.StructType([T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL(_FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                tb = TextBatch(part.column(1))
                base, vals = [], []
                for i in range(tb.n):
                    raw = tb.text(i)
                    low = raw.lower()
                    b, v = base_spans(raw, low), value_spans(raw, low)
                    if b or v:
                        point = np.zeros(len(raw) + 1, dtype=np.int64)
                        np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=point[1:])
                        b = [{"kind": k, "start": point[s], "end": point[e]} for k, s, e in b]
                        v = [
                            {"start": point[s], "end": point[e], "value": raw[s:e].decode()}
                            for s, e in v if point[e] - point[s] >= LEAST_LENGTH
                        ]
                    base.append(b)
                    vals.append(v)
                span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
                value = [("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(base, pa.list_(pa.struct(span))), pa.array(vals, pa.list_(pa.struct(value)))], names=["id", "base", "vals"]
                )

    src = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(run, schema)


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, c): letter runs of 3 to 24 characters, lower-cased, outside the values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE):
                tb = TextBatch(part.column(0))
                data = tb.data.copy()
                for i in range(tb.n):
                    raw = tb.text(i)
                    for s, e in value_spans(raw, raw.lower()):
                        data[tb.offsets[i] + s : tb.offsets[i] + e] = 32
                inside = _LETTER[data]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                cuts = tb.offsets[1:-1][tb.offsets[1:-1] < len(data)]
                first[cuts] |= inside[cuts]
                start = np.flatnonzero(first)
                if not len(start):
                    continue
                at = np.zeros(len(start) + 1, dtype=np.int32)
                np.cumsum(np.add.reduceat(inside, start, dtype=np.int32), out=at[1:])
                words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at), pa.py_buffer(FOLD[data[inside]])]).dictionary_encode()
                size = pc.utf8_length(words.dictionary).to_numpy()
                keep = np.flatnonzero((size >= WORD_SHORT) & (size <= WORD_LONG))
                count = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(keep)), pa.array(count[keep])], ["word", "c"])

    part = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, c long")
    return part.groupBy("word").agg(F.sum("c").alias("c")).filter(F.col("c") >= WORD_LEAST)


def ranked(words: DataFrame) -> DataFrame:
    """(word, rank): the number of words that are as frequent or more so.

    The window runs over the different counts, of which N words have at most the root of 2 N.
    """
    per = words.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    rank = F.sum("k").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
    return words.join(per.select("c", rank.alias("rank")), "c").select("word", "rank")


def word_matches(values: DataFrame, words: DataFrame) -> DataFrame:
    """(no, hits): per value its words as (start, length, replaced letters, rank)."""
    low = F.translate("value", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    signs = "".join(REPLACED)
    v = values.select("no", low.alias("low"), F.translate(low, signs, "".join(REPLACED.values())).alias("plain"))
    v = v.select("*", F.length("low").alias("n")).filter(F.col("n") >= WORD_SHORT)
    v = v.select("*", F.explode(F.sequence(F.lit(1), F.col("n") - (WORD_SHORT - 1))).alias("i"))
    # The letter run that begins here, and its beginnings.
    run = F.length(F.regexp_extract(F.substring("plain", F.col("i"), F.lit(WORD_LONG)), r"^[a-z\x{80}-\x{10FFFF}]*", 0))
    v = v.select("no", "i", F.substring("plain", F.col("i"), F.lit(WORD_LONG)).alias("plain"), F.substring("low", F.col("i"), F.lit(WORD_LONG)).alias("low"), run.alias("n"))
    v = v.filter(F.col("n") >= WORD_SHORT).select("*", F.explode(F.sequence(F.lit(WORD_SHORT), F.col("n"))).alias("k"))
    part = F.substring("low", F.lit(1), F.col("k"))
    swaps = F.col("k") - F.length(F.translate(part, signs, ""))
    v = v.select("no", "i", "k", swaps.alias("swaps"), F.substring("plain", F.lit(1), F.col("k")).alias("word")).filter(F.col("swaps") * 3 <= F.col("k"))
    hit = F.struct((F.col("i") - 1).alias("i"), "k", "swaps", "rank")
    return v.join(words, "word").groupBy("no").agg(F.collect_list(hit).alias("hits"))


# ---------------------------------------------------------------------------
# The cheapest cut of one value
# ---------------------------------------------------------------------------


def _neighbours() -> dict[str, dict[str, tuple[int, int]]]:
    """Key -> neighbouring key -> direction."""
    place = {c: (x + KEY_SHIFT[y], y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row) if c != " "}
    out: dict[str, dict[str, tuple[int, int]]] = {}
    for a, (xa, ya) in place.items():
        for b, (xb, yb) in place.items():
            if a != b and abs(ya - yb) <= 1 and abs(xb - xa) <= 1:
                out.setdefault(a, {})[b] = (int(np.sign(xb - xa)), yb - ya)
    return out


NEIGHBOURS = _neighbours()
_DEGREE = math.log10(sum(map(len, NEIGHBOURS.values())) / len(NEIGHBOURS))
_KEYS = math.log10(len(NEIGHBOURS))
SEGMENTS = ("word", "date", "repeat", "walk", "brute")
_CHOICE = math.log10(len(SEGMENTS))
_DATE = re.compile(
    r"(?=((?P<y>(?:19|20)\d\d)(?P<s>[-/._]?)(?P<m>0[1-9]|1[0-2])(?P=s)(?P<d>0[1-9]|[12]\d|3[01])"
    r"|(?P<a>0[1-9]|[12]\d|3[01])(?P<t>[-/._]?)(?P<b>0[1-9]|[12]\d|3[01])(?P=t)(?P<z>(?:19|20)\d\d)))"
)
_YEAR = re.compile(r"(?=((?:19|20)\d\d))")


def brute_costs(value: str) -> list[float]:
    """log10 of the size of each character's class."""
    size = {"digit": 10, "lower": 26, "upper": 26, "sign": 33, "other": 1000}
    kind = lambda c: "other" if c > "\x7f" else "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else "sign"
    return [math.log10(size[kind(c)]) for c in value]


def word_cost(text: str, swaps: int, rank: int) -> float:
    capitals = sum(c.isupper() for c in text)
    ways = 0.0
    if capitals:
        plain = capitals == len(text) or capitals == 1 and (text[0].isupper() or text[-1].isupper())
        ways = math.log10(2 if plain else sum(math.comb(len(text), i) for i in range(1, min(capitals, len(text) - capitals) + 1)) or 2)
    return math.log10(rank) + ways + swaps * math.log10(2)


def date_hits(value: str) -> Iterator[tuple[int, int, float]]:
    years = lambda y: max(abs(int(y) - YEAR), YEARS_LEAST)
    for m in _DATE.finditer(value):
        if m["y"] or int(m["a"]) <= 12 or int(m["b"]) <= 12:
            sign = m["s"] or m["t"]
            yield m.start(1), m.end(1), math.log10(365 * years(m["y"] or m["z"]) * (4 if sign else 1))
    for m in _YEAR.finditer(value):
        yield m.start(1), m.end(1), math.log10(years(m[1]))


def walk_hits(value: str) -> Iterator[tuple[int, int, float]]:
    """Longest walks along neighbouring keys, of three keys at least."""
    low, i = value.lower(), 0
    while i < len(low):
        j, turns, last = i, 0, None
        while j + 1 < len(low) and (way := NEIGHBOURS.get(low[j], {}).get(low[j + 1])):
            turns += way != last
            last, j = way, j + 1
        if j - i >= 2:
            yield i, j + 1, _KEYS + turns * _DEGREE + math.log10(j - i + 1)
        i = max(j, i + 1)


def repeat_places(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, unit) of the longest runs of a repeated unit."""
    code = np.array([ord(c) for c in value], dtype=np.int64)
    for u in range(1, min(UNIT_LONG, len(code) // 2) + 1):
        same = np.concatenate(([0], (code[:-u] == code[u:]).astype(np.int8), [0]))
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2], edge[1::2]):
            if (times := (b - a) // u + 1) >= (2 if u > 1 else 3):
                yield int(a), int(a + times * u), u


def cheapest(value: str, words: list[tuple[int, int, int, int]]) -> tuple[float, list[tuple[str, int, int]]]:
    """Least log10 of guesses and the segments (kind, start, end) that give it.

    ``words``: (start, length, replaced letters, rank).  Linear in the value and its hits.
    """
    one = brute_costs(value)
    hits = [(i, i + k, word_cost(value[i : i + k], s, r), 0) for i, k, s, r in words]
    hits += [(*h, 1) for h in date_hits(value)] + [(*h, 3) for h in walk_hits(value)]
    by_start: dict[int, list] = {}
    for h in hits:
        by_start.setdefault(h[0], []).append(h)
    known: dict[str, float] = {}
    for a, b, u in repeat_places(value):
        unit = value[a : a + u]
        if unit not in known:
            inside = [(i - a, j - a, c, k) for s in range(a, a + u) for i, j, c, k in by_start.get(s, ()) if j <= a + u and k != 2]
            known[unit] = _cut(one[a : a + u], inside)[0]
        hits.append((a, b, known[unit] + math.log10((b - a) // u), 2))
    cost, cuts = _cut(one, hits)
    return cost, [(SEGMENTS[k], i, j) for i, j, k in cuts]


def _cut(one: list[float], hits: list[tuple[int, int, float, int]]) -> tuple[float, list[tuple[int, int, int]]]:
    n, brute = len(one), len(SEGMENTS) - 1
    ending: dict[int, list] = {}
    for h in sorted(hits, key=lambda h: (h[3], h[0])):
        ending.setdefault(h[1], []).append(h)
    best, last = [0.0] * (n + 1), [(0, 0)] * (n + 1)  # last: (start, kind) of the last segment
    run, run_from = math.inf, 0
    for j in range(1, n + 1):
        if best[j - 1] + _CHOICE < run:
            run, run_from = best[j - 1] + _CHOICE, j - 1
        run += one[j - 1]
        best[j], last[j] = run, (run_from, brute)
        for i, _, c, k in ending.get(j, ()):
            if best[i] + c + _CHOICE < best[j] - 1e-12:
                best[j], last[j] = best[i] + c + _CHOICE, (i, k)
    cuts, j = [], n
    while j:
        i, k = last[j]
        cuts.append((i, j, k))
        j = i
    return best[n], cuts[::-1]


def value_costs(values: DataFrame, words: DataFrame) -> DataFrame:
    """(value, cost, segments) of each different value (no, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, segments = [], []
            for value, hits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c, s = cheapest(value, [(h["i"], h["k"], h["swaps"], h["rank"]) for h in hits or ()])
                cost.append(c)
                segments.append(",".join(f"{k}:{i}:{j}" for k, i, j in s))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cost, pa.float64()), pa.array(segments, pa.string())], ["value", "cost", "segments"])

    hits = word_matches(values, words)
    return values.join(hits, "no", "left").select("value", "hits").mapInArrow(run, "value string, cost double, segments string")


# ---------------------------------------------------------------------------
# The operator
# ---------------------------------------------------------------------------


def guess_costs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, spans array<struct<kind, start, end, cost, segments>> by start, then kind as in KINDS, and max_cost of its values."""
    found = stage(found_spans(docs, id, text).withColumn("key", F.monotonically_increasing_id()), "guess-found")
    places = found.select("key", F.explode("vals").alias("v")).select("key", "v.*")
    values = stage(places.select("value").distinct().withColumn("no", F.monotonically_increasing_id()), "guess-values")
    words = ranked(stage(word_counts(docs, text), "guess-words"))
    costs = stage(value_costs(values, words), "guess-costs")
    scored = places.join(costs, "value").groupBy("key").agg(F.collect_list(F.struct("start", "end", "cost", "segments")).alias("scored"))
    some = found.filter("size(vals) > 0").join(scored, "key")
    none = found.filter("size(vals) = 0").withColumn("scored", F.array().cast(some.schema["scored"].dataType))
    rows = some.select(none.columns).unionByName(none)
    inside = lambda v: F.exists("base", lambda b: (b["start"] <= v["start"]) & (v["end"] <= b["end"]))
    span = lambda kind, s, cost, seg: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"), cost.alias("cost"), seg.alias("segments"))
    base = F.transform("base", lambda b: span(b["kind"], b, F.lit(None).cast("double"), F.lit(None).cast("string")))
    added = F.transform(
        F.filter("scored", lambda v: (v["cost"] >= THRESHOLD) & ~inside(v)), lambda v: span(F.lit(KINDS.index("cost")), v, v["cost"], v["segments"])
    )
    names = F.array(*map(F.lit, KINDS))
    spans = F.transform(
        F.array_sort(F.concat(base, added)),
        lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["cost"].alias("cost"), s["segments"].alias("segments")),
    )
    return rows.select(F.col("id").alias(id), spans.alias("spans"), F.array_max(F.transform("scored", lambda v: v["cost"])).alias("max_cost"))


def digest(spans: DataFrame, id: str = "doc_id") -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as a string."""
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select(id, *map(n, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "max_cost")
