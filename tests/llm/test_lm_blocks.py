"""op5: the two scans form the same blocks, whatever the size of their Arrow batches."""

import pytest

from spate.llm import lm_score


def test_blocks_do_not_depend_on_batches(spark, monkeypatch):
    docs = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(3 + i % 11)), i % 10 == 0) for i in range(2500)]
    df = spark.createDataFrame(docs, "doc_id long, text string, held_out boolean").coalesce(1)
    whole = {r["doc_id"]: r for r in lm_score.lm_scores(df).collect()}
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 40_000)
    got = {r["doc_id"]: r for r in lm_score.lm_scores(df).collect()}
    assert len(got) == len(whole) == 2500
    for i, r in got.items():
        assert r["n_known"] == whole[i]["n_known"] and r["train_tokens"] == whole[i]["train_tokens"]
        assert (r["base_score"], r["score"]) == pytest.approx((whole[i]["base_score"], whole[i]["score"]), rel=1e-12)
