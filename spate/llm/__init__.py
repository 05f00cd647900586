"""Operators of a large-scale training-data pipeline (decontamination, toxicity,
n-gram joins, PII, language-model scoring, token counts, quality, mixing, WARC).

Nothing else in the library imports this package; ``__spark_entry__.py`` adds
its queries only when the folder exists.
"""
