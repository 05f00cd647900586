"""Exact part similarity, error details and the coherence average on small frames."""

import math
from collections import Counter

import pytest

from spate.operators import classify, geo, phrases, similarity


def test_top_similar_texts_equals_plain_cosines(spark):
    parts = [(1, "a", ["x", "y"]), (1, "b", ["x", "x", "x"]), (1, "c", []), (1, "d", ["q"]), (1, "d", ["x"]), (2, "a", None), (3, "z", ["w"])]
    df = spark.createDataFrame(parts, "id long, phrase string, tokens array<string>")
    want = set()
    for i in (1, 2, 3):
        part = {}
        for j, p, t in parts:
            if j == i:
                part.setdefault(p, Counter()).update(t or [])
        part = {p: c for p, c in part.items() if c}
        whole = sum(part.values(), Counter())
        size = lambda c: math.sqrt(sum(v * v for v in c.values()))
        cos = {p: sum(v * whole[t] for t, v in c.items()) / (size(c) * size(whole)) for p, c in part.items()}
        want |= {(i, p, cos[p], k) for k, p in enumerate(sorted(cos, key=lambda p: (-cos[p], p))[:2], start=1)}
    got = {(r["id"], r["phrase"], r["similarity"], r["rank"]) for r in similarity.top_similar_texts(df, n=2).collect()}
    assert {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in want}
    assert {(a, b): c for a, b, c, _ in got} == pytest.approx({(a, b): c for a, b, c, _ in want}, abs=1e-12)
    assert similarity.top_similar_texts(df.limit(0)).count() == 0


def test_error_details(spark):
    posts = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 1, False), (4, 0, True), (5, 0, False)], "id long, mentions_location int, has_location boolean")
    loc = "struct<place_id:long>"
    tops = spark.createDataFrame([(1, "A", (1,)), (2, "Nowhere", None), (4, "B", (2,)), (4, "A", (1,)), (4, "B", (2,)), (4, "Nowhere", None)], f"id long, word string, loc {loc}")
    got = {r["id"]: (r["slice"], r["n_toponyms"], r["detail"], r["names"]) for r in classify.error_details(classify.error_slices(posts), tops).collect()}
    assert got == {
        1: ("TP", 1, "TP", []), 2: ("FN", 1, "FN with toponyms", []), 3: ("FN", 0, "FN without toponyms", []),
        4: ("FP", 4, "FP", ["A", "B"]), 5: ("TN", 0, "TN", []),
    }


def test_average_coherence(spark):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b", "c"])], "id long, tokens array<string>")
    words = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "c"), (1, 2, "a")], "topic int, rank int, term string")
    per = phrases.umass_coherence(docs, words)
    row = phrases.average_coherence(per).first()
    assert row["topics"] == 2 and row["coherence"] == pytest.approx((math.log(2 / 2) + math.log(1 / 1)) / 2)


def test_toponym_starts_are_thinned_before_the_join(spark):
    posts = spark.createDataFrame([(1, "new - york, New York! old york new"), (2, "..."), (3, None)], "id long, text string")
    rows = [("New York", "SE", 1, 0.5), ("York", "SE", 2, 0.5), ("new york city", "SE", 3, 0.5), ("--", "SE", 4, 0.5)]
    names = spark.createDataFrame(rows, "name string, country_code string, place_id long, importance double")
    got = {(r["id"], r["pos"], r["word"]) for r in geo.extract_toponyms(posts, names).collect()}
    assert got == {(1, 2, "york,"), (1, 3, "New York!"), (1, 6, "york")}
    assert {(r["key"], r["first"], r["n"]) for r in geo.name_words(names).collect()} == {("new york", "new", 2), ("york", "york", 1), ("new york city", "new", 3)}
