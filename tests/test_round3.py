"""What travels: RAKE phrases, places of a split, pieces of a batch, keys of rejected posts."""

import numpy as np

from spate.operators import classify, phrases
from spate.sources import posts as src


def test_rake_cuts_the_texts_once(spark):
    df = spark.createDataFrame([(1, "red house. red blue boat!"), (2, "red house, cat|dog"), (None, "red zebra")], "id long, text string")
    out = phrases.rake(df, n=9, stop_words=["the"])
    assert "lower(" not in out._jdf.queryExecution().optimizedPlan().toString()
    # degrees: red 2+3+2+2 of 4, house 2+2 of 2, blue 3, boat 3, cat 1, dog 1; the row without an id lists nothing
    assert [tuple(r) for r in out.collect()] == [("red blue boat", 8.25), ("red house", 4.25), ("cat", 1.0), ("dog", 1.0)]


def test_rake_scores_the_phrases_of_one_id_and_position_together(spark):
    df = spark.createDataFrame([(1, "red boat"), (1, "cat"), (2, "cat")], "id long, text string")
    assert [tuple(r) for r in phrases.rake(df, n=9).collect()] == [("cat", 5.0), ("red boat", 5.0), ("cat", 1.0)]


def test_split_and_undersample_sort_places_only(spark, monkeypatch):
    seen, rank = [], classify.global_rank
    monkeypatch.setattr(classify, "global_rank", lambda df, *a, **k: (seen.append(df.columns), rank(df, *a, **k))[1])
    rows = [(None if i % 3 else i, ["x"] * 5, int(i % 4 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, label int")
    sizes = {r["split"]: r["count"] for r in classify.split(df).groupBy("split").count().collect()}
    assert sizes == {"test": 2, "valid": 2, "train": 36}
    assert {r["label"]: r["count"] for r in classify.undersample(df).groupBy("label").count().collect()} == {0: 10, 1: 10}
    assert seen and all("tokens" not in c for c in seen)


def test_a_model_of_the_users_own_sees_bounded_pieces(spark):
    df = spark.range(300).selectExpr("id", "transform(sequence(1, 2000), i -> concat('word', i, '-', id)) as tokens").coalesce(1)

    def load():
        def model(batch):
            assert sum(len(w) for x in batch["tokens"] for w in x) < 4 << 20
            n = np.array([len(x) for x in batch["tokens"]])
            return np.stack([1 / n, 1 - 1 / n], axis=1)
        return model

    got = classify.predict_with(df, load, ["tokens"]).agg({"softmax": "min", "predicted_label": "min", "id": "count"}).first()
    assert sorted(got.asDict().values()) == [0.9995, 1, 300]


def test_rejects_carry_keys_only(spark):
    rows = [(1, 7, (1,), (["a"],)), (2, 8, (1,), (["a"],)), (3, 7, (9,), (["a"],)), (4, 7, (None,), (["a", "b"],)),
            (5, 7, None, None), (None, 7, (1,), (["b"],)), (6, None, (1,), None), (4, 7, (1,), None)]
    posts = spark.createDataFrame(rows, "id long, author_id long, geo struct<place_id long>, attachments struct<media_keys array<string>>")
    users = spark.createDataFrame([(7, "u"), (7, "v"), (None, "w")], "id long, username string")
    places = spark.createDataFrame([(1, "p")], "id long, name string")
    media = spark.createDataFrame([("a", "photo"), ("a", "video")], "media_key string, type string")
    rejects = src.assemble_posts(posts, users, places, media)[1]
    assert "max_by" not in rejects._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, rejects.collect())) == [
        (2, "missing user"), (3, "missing place"), (4, "missing media"), (4, "missing media"), (6, "missing user")]
