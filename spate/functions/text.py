"""Column expressions for post text: noise removal, cleaning, hashtags.

Everything here builds JVM-side expressions (``regexp_replace``, ``translate``,
``filter`` over ``split``), so cleaning runs inside whole-stage codegen and
scales with the number of rows, never through Python.

The regular expressions are written in the common subset of Java regex (Spark)
and RE2 (the DuckDB oracle), so the same pattern text serves both engines.
"""

from __future__ import annotations

import functools
import pkgutil

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's behaviour for equal results.
# ---------------------------------------------------------------------------

# ASCII punctuation deleted from cleaned text (Python's string.punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Letters allowed in @mentions and #hashtags (ASCII word chars plus å ä ö).
TAG_CHARS = "a-zA-Z0-9_äöåÄÖÅ"

# Longest word kept by the cleaner.
MAX_WORD_LEN = 28

# Emoji code point ranges removed after the token filter:
# emoticons, symbols & pictographs, transport & map symbols, flags.
EMOJI_RANGES = (
    (0x1F600, 0x1F64F),
    (0x1F300, 0x1F5FF),
    (0x1F680, 0x1F6FF),
    (0x1F1E0, 0x1F1FF),
)

# Extra words removed by the second cleaning pass of document preparation.
TOPIC_EXTRA_WORDS = ("flood", "gävle", "gävleborgs", "alberta")

# Prefix marking a repost.
REPOST_PREFIX = "RT"

# ---------------------------------------------------------------------------
# Patterns
# ---------------------------------------------------------------------------

# The characters Python's str.split() treats as whitespace.
WHITESPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)

EMOJI_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in EMOJI_RANGES) + "]"

_URL = (
    "https?://(?:www\\.)?[-a-zA-Z0-9@:%._+~#=]{1,256}\\.[a-zA-Z0-9()]{1,6}\\b"
    "(?:[-a-zA-Z0-9()@:%_+.~#?&/=]*)"
)


def noise_pattern(numbers: bool = True, legacy: bool = False) -> str:
    """Alternation of the noise removed by :func:`strip_noise`.

    ``legacy=True`` keeps the original ``www.[^s]+`` branch, which stops at the
    next letter ``s`` instead of the next whitespace (decision D2).
    """
    www = "www.[^s]+" if legacy else "www.[^\\s]+"
    parts = [www, _URL, f"@[{TAG_CHARS}]*", f"#[{TAG_CHARS}]*", "\\n"]
    if numbers:
        parts.append("[0-9]+")
    return "(" + "|".join(f"(?:{p})" for p in parts) + ")"


@functools.lru_cache(maxsize=None)
def default_stop_words(language: str = "english") -> tuple[str, ...]:
    """Spark MLlib's default stop-word list for ``language``.

    The lists are plain files of this package (``stopwords/*.txt``), read with
    ``pkgutil`` so that they also load from a zip given to ``--py-files``; no JVM
    and no Spark jar is needed.  A test holds them against
    ``StopWordsRemover.loadDefaultStopWords``.
    """
    raw = pkgutil.get_data(__package__, f"stopwords/{language}.txt")
    return tuple(w for w in raw.decode("utf-8").split() if w)


def language_stop_words(language: str) -> tuple[str, ...]:
    """Stop words for the two pipeline languages; other languages are an error."""
    if language not in ("english", "swedish"):
        raise ValueError(f"{language} is not supported")
    return default_stop_words(language)


# ---------------------------------------------------------------------------
# Expressions
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_noise(col, numbers: bool = True, legacy: bool = False) -> Column:
    """Replace URLs, ``www.`` runs, @mentions, whole #hashtags, newlines and
    (optionally) digit runs by one space each."""
    return F.regexp_replace(_col(col), noise_pattern(numbers, legacy), " ")


def split_words(col) -> Column:
    """Whitespace split with Python ``str.split()`` semantics (no empty tokens)."""
    return F.filter(F.split(_col(col), WHITESPACE_CLASS + "+"), lambda w: w != "")


def clean_text(
    col,
    stop_words=None,
    extra_words=(),
    numbers: bool = True,
    legacy: bool = False,
) -> Column:
    """Lower → strip noise → delete ASCII punctuation → split on whitespace →
    drop stop words, extra words and words longer than 28 characters → join by
    one space → delete emoji → collapse and trim spaces (decision D3).

    The word filter is an ``IN`` list, which Catalyst turns into a hash set.
    """
    if stop_words is None:
        stop_words = default_stop_words("english")
    drop = sorted(set(stop_words) | set(extra_words))
    t = F.lower(_col(col))
    t = strip_noise(t, numbers=numbers, legacy=legacy)
    t = F.translate(t, PUNCTUATION, "")
    words = F.filter(
        split_words(t),
        lambda w: (F.length(w) <= MAX_WORD_LEN) & ~w.isin(drop),
    )
    t = F.array_join(words, " ")
    t = F.regexp_replace(t, EMOJI_CLASS + "+", "")
    return F.trim(F.regexp_replace(t, " {2,}", " "))


def hashtags(col) -> Column:
    """T4: whitespace-separated words starting with ``#``, joined by ``", "``."""
    return F.array_join(F.filter(split_words(col), lambda w: w.startswith("#")), ", ")


def tokens(col) -> Column:
    """Tokens of an already cleaned (single-space joined) text; empty → []."""
    return F.filter(F.split(_col(col), " "), lambda w: w != "")


def is_repost(col) -> Column:
    """F2 predicate: text starts with ``RT`` (case-sensitive, no space needed)."""
    return F.coalesce(_col(col).startswith(REPOST_PREFIX), F.lit(False))


# SQL text of the same cleaning, for the DuckDB oracle and for docs.  Built from
# the same constants so the two engines cannot drift apart.


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_clean_text(expr: str, stop_words=None, extra_words=(), numbers=True, legacy=False) -> str:
    """DuckDB SQL for :func:`clean_text` applied to SQL expression ``expr``."""
    if stop_words is None:
        stop_words = default_stop_words("english")
    drop = sorted(set(stop_words) | set(extra_words))
    drop_list = "[" + ", ".join(_sql_str(w) for w in drop) + "]"
    t = f"lower({expr})"
    t = f"regexp_replace({t}, {_sql_str(noise_pattern(numbers, legacy))}, ' ', 'g')"
    t = f"translate({t}, {_sql_str(PUNCTUATION)}, '')"
    words = (
        f"list_filter(regexp_split_to_array({t}, {_sql_str(WHITESPACE_CLASS + '+')}), "
        f"lambda w: w <> '' AND length(w) <= {MAX_WORD_LEN} AND NOT list_contains({drop_list}, w))"
    )
    t = f"array_to_string({words}, ' ')"
    t = f"regexp_replace({t}, {_sql_str(EMOJI_CLASS + '+')}, '', 'g')"
    return f"trim(regexp_replace({t}, ' {{2,}}', ' ', 'g'), ' ')"
