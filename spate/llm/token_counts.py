"""Exact token counts at every prefix of a text, by prefix dynamic programming.

Byte-level BPE never merges across a change from a non-space to a space
character, so a text is a row of *units* (a run of white space and the run of
other characters after it) whose counts add up.  The table of a text holds the
exact count at the end of every unit:

    C[j] = C[j - 1] + count(unit j)

and inside a unit the count at each byte comes from the last-token recurrence

    c[i] = c[i - len(t)] + 1,  t = the last token of the encoding of the prefix

where t is the only vocabulary entry ending at i that stays as it is when it is
encoded together with the last token before it.  Truncation and budget
questions are answered from these tables; nothing is encoded again.

Texts: null counts as empty (0 bytes, 0 tokens).  Special strings inside a text
are one token each and split the text, as the library does by default.
Repeated rows give repeated rows; null ids are kept.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 512

#: Unicode White_Space, as the vocabulary's splitting pattern understands ``\s``.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")

_LEADING = re.compile(f"[{_SPACE}]*")

#: Units remembered per Python worker, in two generations: when the younger is
#: full it becomes the older, and the older goes.
CACHE_UNITS = 400_000
#: Longest unit that is remembered.
CACHE_CHARS = 64


class PrefixCounter:
    """Counts for one byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.path = path
        specials = sorted((t.content for t in self.lib.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.cache: dict[str, int] = {}
        self.older: dict[str, int] = {}
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._tables = None

    # -- counts at unit ends --------------------------------------------------

    def _learn(self, units: list[str]) -> None:
        """Counts of units that are not in the cache, each unit encoded once."""
        if len(self.cache) + len(units) > CACHE_UNITS:
            self.older, self.cache = self.cache, {}
        fresh = []
        for u in units:
            c = self.older.get(u)
            if c is None:
                fresh.append(u)
            else:
                self.cache[u] = c
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            for u, e in zip(part, self.lib.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[u] = len(e.ids)

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at special strings: (part, whether it is special)."""
        if self.special is None or not self.special.search(text):
            return [(text, False)]
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [(text[at : m.start()], False), (m.group(), True)]
            at = m.end()
        return [x for x in [*out, (text[at:], False)] if x[0]]

    def units(self, text: str) -> list[str]:
        return [u for part, special in self.segments(text) for u in ([part] if special else _UNIT.findall(part))]

    def unit_counts(self, texts: list[str]) -> list[list[int]]:
        """Per text the token count of each of its units."""
        rows = [self.units(t) for t in texts]
        get = self.cache.get
        out = [list(map(get, r)) for r in rows]
        missing = {u for r, c in zip(rows, out) if None in c for u, x in zip(r, c) if x is None}
        if missing:
            long = [u for u in missing if len(u) > CACHE_CHARS]
            self._learn([u for u in missing if len(u) <= CACHE_CHARS])
            found = dict(zip(long, (len(e.ids) for e in self.lib.encode_batch_fast(long, add_special_tokens=False))))
            get = self.cache.get
            for r, c in zip(rows, out):
                if None in c:
                    c[:] = [(found[u] if len(u) > CACHE_CHARS else get(u)) if x is None else x for u, x in zip(r, c)]
        return out

    def table(self, text: str) -> tuple[list[int], list[int]]:
        """Unit ends (code points) and the exact token count at each of them."""
        ends, cum, at, n = [], [], 0, 0
        for u, c in zip(self.units(text), self.unit_counts([text])[0]):
            at += len(u)
            n += c
            ends.append(at)
            cum.append(n)
        return ends, cum

    # -- counts inside a unit -------------------------------------------------

    def _load(self):
        """Vocabulary and merge ranks as byte strings (read once, only when asked for)."""
        if self._tables is None:
            with open(self.path, encoding="utf-8") as f:
                model = json.load(f)["model"]
            as_byte = _byte_of_char()
            raw = lambda s: bytes(as_byte[c] for c in s)
            ranks = {}
            for k, m in enumerate(model["merges"]):
                a, b = m.split(" ") if isinstance(m, str) else m
                ranks[raw(a), raw(b)] = k
            vocab = {raw(s) for s in model["vocab"] if all(c in as_byte for c in s)}
            self._tables = (ranks, vocab, max(map(len, vocab)))
        return self._tables

    def _merge(self, text: bytes) -> list[bytes]:
        ranks = self._load()[0]
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best = min(((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:]))), default=None)
            if best is None or best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _stays(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a and b next to each other are encoded as a and b."""
        hit = self._pairs.get((a, b))
        if hit is None:
            if len(self._pairs) > CACHE_UNITS:
                self._pairs.clear()
            hit = self._pairs[a, b] = (self._merge(a + b) == [a, b])
        return hit

    def piece_prefixes(self, piece: bytes) -> list[int]:
        """Token count of every byte prefix of one piece: the last-token recurrence."""
        _, vocab, longest = self._load()
        count, last = [0], [b""]
        for i in range(1, len(piece) + 1):
            for n in range(min(i, longest), 0, -1):
                t = piece[i - n : i]
                if t in vocab and self._merge_is_whole(t) and (n == i or self._stays(last[i - n], t)):
                    count.append(count[i - n] + 1)
                    last.append(t)
                    break
        return count

    @lru_cache(maxsize=200_000)  # noqa: B019  one counter per worker process
    def _merge_is_whole(self, t: bytes) -> bool:
        return self._merge(t) == [t]

    def unit_prefixes(self, unit: str) -> list[int]:
        """Token count of every code point prefix of a unit.

        A prefix that ends inside a piece takes the count at that place of the
        piece's table.  Only two kinds of cut change the pieces: in the white
        space at the start, which is one run then and has a table of its own,
        and inside a contraction, which is encoded as it is.
        """
        out, base, at = [0], 0, 0
        size = lambda t: len(self.lib.encode(t, add_special_tokens=False).ids)
        space = _LEADING.match(unit).group()
        run = self.piece_prefixes(space.encode())
        ends = [0]
        for ch in space:
            ends.append(ends[-1] + len(ch.encode()))
        for p in _pieces().findall(unit):
            table = self.piece_prefixes(p.encode("utf-8", "surrogatepass"))
            place = 0
            for k, ch in enumerate(p, start=1):
                place += len(ch.encode("utf-8", "surrogatepass"))
                if at + k <= len(space):
                    out.append(run[ends[at + k]])
                elif k == len(p):
                    out.append(base + table[-1])
                elif p[0] == "'" and p[1].isalpha():
                    out.append(base + size(p[:k]))
                else:
                    out.append(base + table[place])
            base += table[-1]
            at += len(p)
        return out

    # -- questions ------------------------------------------------------------

    def count_at(self, text: str, chars: int) -> int:
        """Exact token count of ``text[:chars]``."""
        at, n = 0, 0
        for u, c in zip(self.units(text), self.unit_counts([text])[0]):
            if at + len(u) > chars:
                return n + (0 if chars == at else self._inside(u)[chars - at])
            at += len(u)
            n += c
        return n

    def _inside(self, unit: str) -> list[int]:
        return self.unit_prefixes(unit)

    def cut(self, units: list[str], counts: list[int], budget: int) -> int:
        """Code points of the longest prefix that needs at most ``budget`` tokens."""
        at, n = 0, 0
        for u, c in zip(units, counts):
            if n + c > budget:
                if self.special is not None and self.special.fullmatch(u):
                    return at
                inner = self._inside(u)
                return at + max(i for i, x in enumerate(inner) if n + x <= budget)
            at += len(u)
            n += c
        return at


@lru_cache(maxsize=1)
def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes a byte as a printable character: itself, or U+0100 upwards in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _pieces():
    import regex

    # Fixed value: the splitting pattern of the vocabulary's public family.
    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=2)
def counter(path: str) -> PrefixCounter:
    """One counter per file and Python worker."""
    return PrefixCounter(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(
    docs: DataFrame,
    vocabulary: str | None = None,
    budget: int = LIMIT,
    doc_id: str = "doc_id",
    text: str = "text",
    tables: bool = False,
) -> DataFrame:
    """Per document row: n_bytes, n_tokens, over_limit, cut_chars (longest prefix within the budget).

    ``tables=True`` adds the prefix table itself (``unit_ends``, ``unit_counts``
    as running totals).  Map-only: no shuffle, no state but a bounded cache.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[doc_id].dataType
    arrow_id = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary or default_vocabulary())
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                texts = [t or "" for t in b.column(1).to_pylist()]
                counts = c.unit_counts(texts)
                total = [sum(x) for x in counts]
                cuts = [len(t) if n <= budget else c.cut(c.units(t), x, budget) for t, x, n in zip(texts, counts, total)]
                columns = [
                    pa.array(b.column(0).to_pylist(), arrow_id),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array(total, pa.int64()),
                    pa.array([n > budget for n in total], pa.bool_()),
                    pa.array(cuts, pa.int64()),
                ]
                names = [doc_id, "n_bytes", "n_tokens", "over_limit", "cut_chars"]
                if tables:
                    both = [c.table(t) for t in texts]
                    columns += [pa.array([x[j] for x in both], pa.list_(pa.int64())) for j in (0, 1)]
                    names += ["unit_ends", "unit_counts"]
                yield pa.RecordBatch.from_arrays(columns, names)

    fields = [
        T.StructField(doc_id, id_type),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()),
        T.StructField("cut_chars", T.LongType()),
    ]
    if tables:
        fields += [T.StructField(n, T.ArrayType(T.LongType())) for n in ("unit_ends", "unit_counts")]
    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, T.StructType(fields))
