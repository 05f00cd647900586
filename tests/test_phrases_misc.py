"""M9 coherence, K5 top-similar, A6 entity counts, T7 RAKE, M3 greedy bigrams
against small hand computations."""

import math

from pyspark.sql import functions as F

from spate.operators import geo, phrases, similarity


def test_umass_coherence_matches_hand_count(spark):
    docs = spark.createDataFrame(
        [(1, ["rain", "flood", "road"]), (2, ["rain", "flood"]), (3, ["rain"]), (4, ["road"])],
        "id long, tokens array<string>",
    )
    top = spark.createDataFrame([(0, 1, "rain"), (0, 2, "flood"), (0, 3, "road")], "topic int, rank int, term string")
    got = phrases.umass_coherence(docs, top).first()["coherence"]
    D = {"rain": 3, "flood": 2, "road": 2}
    co = {("flood", "rain"): 2, ("road", "rain"): 1, ("road", "flood"): 1}
    want = sum(math.log((co[(wi, wj)] + 1) / D[wj]) for wi, wj in co)
    assert abs(got - want) < 1e-12


def test_top_similar_per_document(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, embedding array<float>")
    cands = spark.createDataFrame(
        [(1, "a", [1.0, 0.1]), (1, "b", [0.0, 1.0]), (1, "c", [1.0, 0.5]), (2, "d", [0.1, 1.0])],
        "id long, phrase string, embedding array<float>",
    )
    got = {(r["id"], r["rank"], r["phrase"]) for r in similarity.top_similar(docs, cands, n=2).collect()}
    assert got == {(1, 1, "a"), (1, 2, "c"), (2, 1, "d")}


def test_entity_counts_strip_prefixes(spark):
    toks = [("B-LOC", "Gävle"), ("I-LOC", "Gävle"), ("ORG", "Acme")]
    df = spark.createDataFrame([(1, [{"entity": e, "word": w} for e, w in toks])], "id long, tokens array<struct<entity:string,word:string>>")
    got = {(r["entity"], r["word"], r["count"]) for r in geo.entity_counts(df).collect()}
    assert got == {("LOC", "Gävle", 2), ("ORG", "Acme", 1)}


def test_rake_scores(spark):
    df = spark.createDataFrame([(1, "heavy rain, flooded roads. heavy rain today")], "id long, text string")
    got = {r["phrase"]: r["score"] for r in phrases.rake(df, n=10).collect()}
    # phrases: "heavy rain", "flooded roads", "heavy rain today"
    # degree/freq: heavy 5/2, rain 5/2, flooded 2/1, roads 2/1, today 3/1
    assert got == {"heavy rain": 5.0, "flooded roads": 4.0, "heavy rain today": 8.0}


def test_greedy_bigrams_no_overlap(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"])], "id long, tokens array<string>")
    ph = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    out = phrases.apply_bigrams(docs, ph).first()["tokens"]
    assert out == ["a", "b", "c", "a", "b", "a_b", "a_b"]
    assert phrases.bigram_positions(docs, ph).select(F.collect_list("pos")).first()[0] is not None
