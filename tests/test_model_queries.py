"""Invariants of the registered rows-only (model / iterative) queries on sf0.001."""

import math

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def q():
    return entry.queries()


def test_kmeans_assigns_every_row(spark, q):
    rows = q["kmeans"](spark, SF_SMALL).collect()
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").count()
    assert {r["cluster"] for r in rows} <= set(range(5))


def test_project_2d_finite(spark, q):
    rows = q["project_2d"](spark, SF_SMALL).collect()
    assert rows and all(math.isfinite(r["x"]) and math.isfinite(r["y"]) for r in rows)


def test_topic_terms_and_coherence(spark, q):
    rows = q["topic_terms"](spark, SF_SMALL).collect()
    assert rows and all(r["count"] >= 1 and r["topic0"] >= 0 and r["topic1"] >= 0 for r in rows)
    coh = q["topic_coherence"](spark, SF_SMALL).collect()
    assert len(coh) == 2 and all(math.isfinite(r["coherence"]) for r in coh)


def test_lsi_components(spark, q):
    rows = q["lsi"](spark, SF_SMALL).collect()
    assert {r["component"] for r in rows} == {0, 1}
    assert all(abs(r["weight"]) <= 1 + 1e-9 for r in rows)


def test_classifier_queries(spark, q):
    m = q["classifier_metrics"](spark, SF_SMALL).first()
    n = m["tp"] + m["tn"] + m["fp"] + m["fn"]
    assert n > 0 and 0 <= m["accuracy"] <= 1
    rows = q["predict_relevance"](spark, SF_SMALL).collect()
    assert all(0.5 <= r["softmax"] <= 1 and r["loss"] >= 0 and r["predicted_label"] in (0, 1) for r in rows)
    hard = q["hardest_positives"](spark, SF_SMALL).collect()
    losses = [r["loss"] for r in hard]
    assert len(hard) <= 100 and all(r["label"] == 1 for r in hard) and losses == sorted(losses, reverse=True)


def test_top_similar_turns(spark, q):
    rows = q["top_similar_turns"](spark, SF_SMALL).collect()
    per = {}
    for r in rows:
        per.setdefault(r["id"], []).append(r["rank"])
    assert per and all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 2 for v in per.values())
