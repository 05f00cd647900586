"""Post cleaning: repost filter, text cleaning and exact-text de-duplication.

F2 ``drop_reposts``, F3 (inside ``clean_posts``), A1 ``dedup_text``,
T3 ``clean_posts``, F10 ``min_tokens``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spate.functions import text as tx
from spate.operators.groups import first_per_group, with_computed


def drop_reposts(df: DataFrame, text: str = "text") -> DataFrame:
    """drop posts whose text starts with ``RT``.  Null text is kept here
    (it is dropped later by the empty-text filter)."""
    return df.filter(~tx.is_repost(F.col(text)))


def dedup_text(df: DataFrame, text: str = "text", order: str = "id") -> DataFrame:
    """A1: keep one row per distinct ``text``: the first in ``order``.

    A partial ``min_by`` aggregate: a text copied into a third of all rows is
    combined map-side, so no task ever holds the whole group.
    """
    return first_per_group(df, [text], [order])


def clean_posts(
    df: DataFrame,
    order: str = "id",
    text: str = "text",
    translated: str | None = None,
    stop_words=None,
    extra_words=(),
    numbers: bool = True,
    legacy: bool = False,
    dedup: bool = True,
) -> DataFrame:
    """F2 → keep ``text_raw`` → ``text_translated`` (the given column, else a
    copy) → T2 → F3 (drop null/empty) → A1 (first in ``order`` per cleaned text).
    """
    out = drop_reposts(df, text)
    out = out.withColumn("text_raw", F.col(text))
    out = out.withColumn(
        "text_translated", F.col(translated) if translated else F.col(text)
    )
    out = with_computed(
        out,
        text,
        tx.clean_text(
            F.col("text_translated"),
            stop_words=stop_words,
            extra_words=extra_words,
            numbers=numbers,
            legacy=legacy,
        ),
    )
    out = out.filter(F.col(text).isNotNull() & (F.col(text) != ""))
    return dedup_text(out, text, order) if dedup else out


def min_tokens(df: DataFrame, tokens: str = "tokens", min_len: int = 2, min_words: int = 0) -> DataFrame:
    """drop tokens shorter than ``min_len`` characters, then documents with
    at most ``min_words`` tokens (``min_words=0`` keeps every document)."""
    out = df.withColumn(tokens, F.filter(F.col(tokens), lambda w: F.length(w) >= min_len))
    if min_words:
        out = out.filter(F.size(tokens) > min_words)
    return out
