"""M18 with a model of the user's own, against MLlib's scoring of the same model."""

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF

from spate.operators import classify
from spate.plans.registry import _labelled_tokens
from spate.session import cut_lineage
from conftest import SF_SMALL


def test_murmur3_is_the_hash_of_hashing_tf(spark):
    tf = HashingTF(inputCol="a", outputCol="b", numFeatures=1 << 18)
    for word in ["", "a", "ab", "abc", "abcd", "abcde", "översvämning", "\U0001F600", "x" * 1001]:
        assert classify.murmur3(word.encode()) % (1 << 18) == tf.indexOf(word)


def test_equal_to_predict(spark):
    data = cut_lineage(_labelled_tokens(spark, SF_SMALL).withColumnRenamed("relevant", "label"))
    model = classify.train(data, label="label", max_iter=5)
    stored = spark.sparkContext.broadcast(classify.HashedLinear.of(model))
    scored = classify.predict_with(data, lambda: stored.value, ["tokens"])
    assert scored._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = {r["id"]: r for r in classify.predict(data, model).collect()}
    got = {r["id"]: r for r in scored.collect()}
    assert got.keys() == want.keys() and len(got) > 0
    for i, r in got.items():
        assert abs(r["softmax"] - want[i]["softmax"]) < 1e-9 and r["predicted_label"] == want[i]["predicted_label"]
        assert np.allclose(r["probability"], want[i]["probability"], atol=1e-9)


def test_ties_nulls_empty_tables_and_replaced_columns(spark):
    df = spark.createDataFrame([(1, None, 9.0), (2, ["a", "a"], 9.0), (2, ["a", "a"], 9.0), (3, [], 9.0)], "id long, tokens array<string>, softmax double")
    load = lambda: classify.HashedLinear(np.zeros(8), 0.0)
    out = classify.predict_with(df, load, ["tokens"])
    assert out.columns == ["id", "tokens", "softmax", "predicted_label", "probability"]
    assert [(r["id"], r["softmax"], r["predicted_label"]) for r in out.orderBy("id").collect()] == [(1, 0.5, 0), (2, 0.5, 0), (2, 0.5, 0), (3, 0.5, 0)]
    assert classify.predict_with(df.limit(0), load, ["tokens"]).count() == 0


def test_wrong_shape_is_an_error(spark):
    df = spark.createDataFrame([(1, ["a"])], "id long, tokens array<string>")
    with pytest.raises(Exception, match="the model gave shape"):
        classify.predict_with(df, lambda: lambda b: np.zeros(len(b)), ["tokens"]).collect()
