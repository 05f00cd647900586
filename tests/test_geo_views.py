"""Place operators, selections and sampling on edge-row fixtures (FIXTURES.md §2)."""

import datetime

from pyspark.sql import functions as F

from spate.operators import classify, dedup, geo, views
from spate.sources import gazetteer as gz
from spate.sources import regions as rg

LOC = "struct<place_id:long,display_name:string,boundingbox:array<string>,lat:string,lon:string,class:string,type:string,importance:double>"


def _loc(pid, name, bb):
    return (pid, name, bb, "0", "0", "place", "town", 0.5)


def test_smallest_location_rules(spark):
    rows = [
        (1, 0, "Sweden", _loc(1, "Sweden", ["55", "69", "10", "24"])),
        (1, 1, "Big", _loc(2, "Big, X, Sweden", ["55", "57", "10", "12"])),
        (1, 2, "Tie1", _loc(3, "Tie1, Sweden", ["55", "55.1", "10", "10.1"])),
        (1, 3, "Tie2", _loc(4, "Tie2, Sweden", ["56", "56.1", "11", "11.1"])),
        (2, 0, "County", _loc(5, "Some, Lan, Sweden", ["55", "55.1", "10", "10.1"])),
        (2, 1, "Nowhere", None),
        (3, 0, "Huge", _loc(6, "Huge, Sweden", ["-90", "90", "-180", "900"])),
    ]
    df = spark.createDataFrame(rows, f"id long, pos int, word string, loc {LOC}")
    got = {r["id"]: r["loc"]["place_id"] for r in geo.smallest_location(df).collect()}
    assert got == {1: 3}  # tie → earlier toponym; county, unresolved and ≥999 skipped
    assert geo.country_mentions(df).first()["country_mentions"] == 1


def test_resolve_toponyms_best_record_and_country(spark):
    t = spark.createDataFrame([(1, 0, "Gävle"), (1, 1, "Alberta"), (1, 2, "Atlantis"), (2, 0, "uddevalla")], "id long, pos int, word string")
    got = {(r["id"], r["word"]): (r["loc"]["place_id"] if r["loc"] else None) for r in geo.resolve_toponyms(t, gz.sample_gazetteer(spark)).collect()}
    assert got == {(1, "Gävle"): 3, (1, "Alberta"): None, (1, "Atlantis"): None, (2, "uddevalla"): 14}


def test_extract_toponyms_phrase_join(spark):
    text = "Tyck till om länsstyrelsens riskhanteringsplan för översvämning https://t.co/3GlphvDKci #UAkommun #Uddevalla #Ljungskile"
    more = "Flooding in Västra Götalands Lan near Uddevalla and again Uddevalla"
    posts = spark.createDataFrame([(1, text), (2, more)], "id long, text string")
    got = {(r["id"], r["word"], r["pos"]) for r in geo.extract_toponyms(posts, gz.sample_gazetteer(spark), country="SE").collect()}
    # hashtags are noise; the three-word county wins over its parts; a repeated word keeps its first place
    assert got == {(2, "Västra Götalands Lan", 2), (2, "Uddevalla", 6)}


def _names(spark, *names):
    rows = [(n, "SE", i, n, ["55", "55.1", "10", "10.1"], "0", "0", "place", "town", 0.5) for i, n in enumerate(names)]
    cols = "name string, country_code string, place_id long, display_name string, boundingbox array<string>, lat string, lon string, class string, type string, importance double"
    return spark.createDataFrame(rows, cols)


def test_extract_toponyms_overlaps_and_long_names(spark):
    posts = spark.createDataFrame([(1, "Alfa Beta Gamma Delta"), (2, "near Upper Alfa by the Sea today"), (3, None), (4, "")], "id long, text string")
    g = _names(spark, "Alfa Beta", "Beta Gamma Delta", "Gamma", "Upper Alfa by the Sea")
    got = {(r["id"], r["word"], r["pos"]) for r in geo.extract_toponyms(posts, g).collect()}
    # "Beta Gamma Delta" overlaps the phrase taken before it; "Gamma" does not
    assert got == {(1, "Alfa Beta", 0), (1, "Gamma", 2), (2, "Upper Alfa by the Sea", 1)}
    assert geo.extract_toponyms(posts, g.limit(0)).collect() == []


def test_repeated_place_keeps_its_order_in_ties(spark):
    g = _names(spark, "Orust", "Tjorn")
    posts = spark.createDataFrame([(1, "Orust och Tjorn och Orust")], "id long, text string")
    tops = geo.resolve_toponyms(geo.extract_toponyms(posts, g), g)
    assert geo.smallest_location(tops).first()["loc"]["display_name"] == "Orust"
    tok = "array<struct<entity:string,word:string,score:double>>"
    df = spark.createDataFrame([(1, [("LOC", "Orust", 0.5), ("B-LOC", "Tjorn", 0.6), ("LOC", "Orust", 0.9)])], f"id long, tokens {tok}")
    assert {tuple(r) for r in geo.location_tokens(df).collect()} == {(1, 0, "Orust", 0.9), (1, 1, "Tjorn", 0.6)}


def test_points_in_regions_edges_holes_multipolygon(spark):
    pts = [
        (1, 11.5, 55.5),   # inside South
        (2, 12.5, 56.5),   # in South's hole
        (3, 11.0, 57.0),   # on South's outer edge
        (4, 16.0, 59.0),   # vertex of South
        (5, 12.0, 64.0),   # second part of North
        (6, 30.0, 30.0),   # outside everything
        (7, None, None),   # no coordinates
        (8, 18.5, 56.5),   # inside Isle and Middle
    ]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {(r["id"], r["region_name"]) for r in geo.points_in_regions(df, rg.sample_regions(spark)).collect()}
    assert (1, "South") in got and (3, "South") in got and (4, "South") in got
    assert (2, "South") not in got
    assert (5, "North") in got
    assert {i for i, _ in got} == {1, 3, 4, 5, 8}
    assert {(8, "Isle"), (8, "Middle")} <= got
    assert geo.filter_region(df, rg.sample_regions(spark), None).count() == 8


def test_merge_subwords(spark):
    toks = [
        ("LOC", "Udde", 0.9, 0, 4, 1),
        ("LOC", "##valla", 0.5, 4, 9, 2),
        ("O", "och", 0.99, 10, 13, 3),
        ("B-LOC", "Gävle", 0.8, 14, 19, 4),
    ]
    df = spark.createDataFrame([(1, toks), (2, [("LOC", "##x", 0.7, 0, 1, 1)])],
                               "id long, tokens array<struct<entity:string,word:string,score:double,start:int,end:int,index:int>>")
    out = {r["id"]: [(t["entity"], t["word"], t["score"], t["end"]) for t in r["tokens"]] for r in geo.merge_subwords(df).collect()}
    assert out[1] == [("LOC", "Uddevalla", 0.9, 9), ("B-LOC", "Gävle", 0.8, 19)]
    assert out[2] == [("LOC", "##x", 0.7, 1)]
    locs = {(r["id"], r["word"]) for r in geo.location_tokens(geo.merge_subwords(df)).collect()}
    assert locs == {(1, "Uddevalla"), (1, "Gävle"), (2, "##x")}


def test_one_per_user_week_boundaries(spark):
    ts = datetime.datetime
    rows = [
        (1, ts(2024, 1, 7, 23, 59, 59), 1, "A"),  # Sunday → week ending Jan 7
        (2, ts(2024, 1, 8, 0, 0, 0), 1, "A"),     # Monday → next week
        (3, ts(2024, 1, 8, 0, 0, 0), 1, "A"),     # same instant → smaller id wins
        (4, ts(2024, 1, 9), None, "A"),           # null user dropped
        (5, ts(2024, 1, 9), 1, "B"),              # other location same week
    ]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, user_id long, loc_name string")
    got = {(r["id"], str(r["week"])) for r in dedup.one_per_user_week(df, loc="loc_name").collect()}
    assert got == {(1, "2024-01-07"), (2, "2024-01-14"), (5, "2024-01-14")}
    got2 = {r["id"] for r in dedup.one_per_user_week(df).collect()}
    assert got2 == {1, 2}


def test_time_histogram_spine_and_sum(spark):
    ts = datetime.datetime
    rows = [(1, ts(2023, 12, 30)), (2, ts(2024, 1, 2)), (3, ts(2024, 1, 2)), (4, ts(2023, 12, 31))]
    df = spark.createDataFrame(rows, "id long, created_at timestamp")
    sel = spark.createDataFrame([(2,)], "id long")
    h = views.time_histogram(df, sel).collect()
    by = {(r["series"], str(r["bin"])): r["n"] for r in h}
    assert by[("not_selected", "2024-01-01")] == 0  # empty day inside the span
    assert sum(r["n"] for r in h) == 4
    assert {k for k in by if k[0] == "selected"} == {("selected", "2024-01-02")}


def test_undersample_and_split_sizes(spark):
    df = spark.range(0, 103).select(F.col("id"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    us = classify.undersample(df, "label", seed=3)
    counts = {r["label"]: r["count"] for r in us.groupBy("label").count().collect()}
    assert counts == {0: 21, 1: 21}
    sp = {r["split"]: r["count"] for r in classify.split(df, seed=3).groupBy("split").count().collect()}
    assert sp == {"test": 6, "valid": 5, "train": 92}


def test_binary_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, predicted_label int")
    r = classify.binary_metrics(df).first()
    assert r["accuracy"] == 1.0 and r["precision"] is None and r["recall"] is None and r["f1"] is None


def test_page_ties_and_past_end(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(10)], "id long, v double")
    p0 = [r["id"] for r in views.page(df, sort="v", desc=False, page_no=0, size=4).collect()]
    p1 = [r["id"] for r in views.page(df, sort="v", desc=False, page_no=1, size=4).collect()]
    assert p0 == [0, 3, 6, 9] and p1 == [1, 4, 7, 2]
    assert views.page(df, sort="v", page_no=5, size=4).count() == 0
