"""A training-corpus pipeline over ``documents``: five stages, each a whole operator.

Every stage reads what the one before it kept, and its decisions take effect.
Toxicity is fitted on the labelled rows whose crc32(doc_id) mod 4 is not 2, as
in the query of that operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spate.llm import decontaminate, mixing, ngram_join, pii, toxicity
from spate.llm.common import crc_mod, stage, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2))
    return toxicity.remove_toxic(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it replaced in the texts; ``n_chars`` follows the text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The selected documents with all their columns, one row per epoch they are taken in, plus epoch, domain and n_tokens.

    Rows that share an id are taken together; columns that ``docs`` has already keep their values.
    """
    more = [c for c in ("epoch", "domain", "n_tokens") if c not in docs.columns]
    picked = mixing.mix(docs).dropDuplicates(["doc_id", "epoch"]).select(F.col("doc_id").alias("picked_id"), *more)
    return docs.join(picked, docs["doc_id"].eqNullSafe(picked["picked_id"])).drop("picked_id")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed),
]

#: The classifier and the disclosure statistics have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
