"""Queries of the operators over the driver tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spate.llm import collocations as co
from spate.llm import decontaminate as dc
from spate.llm import guess_cost as gc
from spate.llm import lm_score as lm
from spate.llm import mixing
from spate.llm import ngram_join as nj
from spate.llm import pii
from spate.llm import quality_gam as gam
from spate.llm import quality_rules as qr
from spate.llm import token_counts as tc
from spate.llm import toxicity as tx
from spate.llm import warc
from spate.llm import whitening as wh
from spate.llm.common import crc_mod, stage_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


@register("op1_decontaminate", dc.ORACLE_SQL)
def op1(spark, sf_dir):
    out = dc.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("hit_spans")


@register("op2_toxicity")
def op2(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = tx.fit(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    return tx.score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted", "n_toxic", "spans")


@register("op3_ngram_join")
def op3(spark, sf_dir):
    return nj.ngram_join(table(spark, sf_dir, "documents"))


@register("op4_pii")
def op4(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


@register("op5_lm_score")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm.lm_scores(docs.withColumn("held_out", crc_mod("doc_id", 10) == 0))


@register("op6_token_counts")
def op6(spark, sf_dir):
    return tc.token_counts(table(spark, sf_dir, "documents"))


@register("op7_quality_rules")
def op7(spark, sf_dir):
    return qr.quality_rules(table(spark, sf_dir, "documents"))


@register("op8_mixing", mixing.oracle_sql())
def op8(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@register("op9_quality_gam")
def op9(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = gam.classify(docs, labels.filter(crc_mod("doc_id", 3) != 1))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@register("op10_warc_revisits", warc.ORACLE_SQL)
def op10(spark, sf_dir):
    path = stage_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.page_digests(warc.read_archives(spark, path, with_block=False))


@register("op11_whitening")
def op11(spark, sf_dir):
    return wh.whiten(table(spark, sf_dir, "embeddings"))


@register("op12_guess_cost")
def op12(spark, sf_dir):
    return gc.digest(gc.guess_costs(table(spark, sf_dir, "documents")))


@register("op13_collocations", co.ORACLE_SQL)
def op13(spark, sf_dir):
    return co.collocations(table(spark, sf_dir, "documents"))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
