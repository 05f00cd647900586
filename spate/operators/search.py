"""Post search and simple predicates: F1 ``keyword_search``, F4
``relevant_only``, F8 ``located_only``.

The keyword search is one regular expression over the lower-cased text (one
pass per row, inside codegen), plus a half-open time range that Parquet can
prune on.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The flood search terms (Swedish), quoted phrases as two words.
FLOOD_TERMS = [
    "atmosfärisk flod", "hög vatten", "åskskur", "regnskur", "dagvattensystem", "dränering",
    "höga vågor", "höga flöden", "dämmor", "snösmältning", "blött", "oväder", "stormflod",
    "vattenstånd", "vattennivå", "åskväder", "regnstorm", "mycket regn", "kraftig regn",
    "översvämningsskador", "översvämningar", "översvämning",
]

_WORD = "\\p{L}\\p{N}_"


def keyword_pattern(terms) -> str:
    """Whole-word alternation of the terms (phrases match across any run of
    whitespace); written without look-around so SQL engines read it too."""
    alts = sorted({t.lower().strip() for t in terms if t.strip()}, key=lambda t: (-len(t), t))
    body = "|".join("\\s+".join(re.escape(w) for w in t.split()) for t in alts)
    return f"(^|[^{_WORD}])({body})($|[^{_WORD}])"


def keyword_search(df: DataFrame, terms=FLOOD_TERMS, start=None, end=None, extra=(), text: str = "text", ts: str = "created_at") -> DataFrame:
    """posts mentioning any term or phrase (case-insensitive, whole
    words), optionally extended by ``extra`` terms, in ``[start, end)``."""
    out = df.filter(F.lower(F.col(text)).rlike(keyword_pattern(list(terms) + list(extra))))
    if start is not None:
        out = out.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        out = out.filter(F.col(ts) < F.lit(end).cast(df.schema[ts].dataType))
    return out


def relevant_only(df: DataFrame, label: str = "predicted_label") -> DataFrame:
    """keep posts predicted relevant."""
    return df.filter(F.col(label) == 1)


def located_only(df: DataFrame, col: str = "loc_name") -> DataFrame:
    """F8: keep posts with a resolved location."""
    return df.filter(F.col(col).isNotNull())
