"""Edge rows of FIXTURES.md §2 for M4 (TF-IDF), M3 (bigram counts) and A8."""

import datetime
import math

from spate.operators import phrases, terms, views


def test_tfidf_edges(spark):
    fit = spark.createDataFrame(
        [(1, ["flood", "rain", "rain"]), (2, ["flood", "road"]), (3, ["flood"])],
        "id long, tokens array<string>",
    )
    apply = spark.createDataFrame([(1, ["flood", "rain", "rain"]), (3, ["flood"]), (9, ["unseen", "road"])], "id long, tokens array<string>")
    got = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(apply, fit_on=fit).collect()}
    # "flood" is in every fitted document: weight 0, dropped; doc 3 has only
    # zero weights and vanishes; "unseen" was not fitted and is ignored.
    assert set(got) == {(1, "rain"), (9, "road")}
    assert math.isclose(got[(1, "rain")], 1.0) and math.isclose(got[(9, "road")], 1.0)
    idf_road = math.log2(3 / 1)
    assert idf_road > 0


def test_bigram_min_count_boundary(spark):
    # "a b" appears 21 times, "c d" 20 times; with min_count 20 only counts
    # above 20 can score positive.
    docs = [(i, ["a", "b"]) for i in range(21)] + [(100 + i, ["c", "d"]) for i in range(20)]
    df = spark.createDataFrame(docs, "id long, tokens array<string>")
    got = {(r["a"], r["b"]) for r in phrases.bigram_phrases(df, min_count=20, threshold=0.0).collect()}
    assert got == {("a", "b")}
    row = phrases.bigram_phrases(df, min_count=20, threshold=0.0).first()
    v = 4 + 2  # distinct unigrams + distinct pairs
    assert math.isclose(row["score"], (21 - 20) / 21 / 21 * v)


def test_label_series_weeks_with_gap(spark):
    ts = datetime.datetime
    rows = [(ts(2024, 1, 1), 1, 0), (ts(2024, 1, 7, 23, 59, 59), 1, 1), (ts(2024, 1, 22), 0, 1)]
    df = spark.createDataFrame(rows, "created_at timestamp, relevant int, mentions_impact int")
    got = [(str(r["bin"]), r["relevant"], r["mentions_impact"]) for r in views.label_series(df, ["relevant", "mentions_impact"]).collect()]
    assert got == [("2024-01-07", 2, 1), ("2024-01-14", 0, 0), ("2024-01-21", 0, 0), ("2024-01-28", 0, 1)]
