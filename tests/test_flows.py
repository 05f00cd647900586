"""Composite plans on small fixtures: they run and keep their invariants."""

import datetime

from pyspark.sql import functions as F

from spate.plans import flows
from spate.sources import gazetteer as gz


def _posts(spark):
    ts = datetime.datetime
    rows = [
        (1, "Översvämning i Uddevalla nu", ts(2021, 8, 19, 10), 1, "a"),
        (2, "översvämning vid Ljungskile och Uddevalla", ts(2021, 8, 19, 11), 1, "a"),
        (3, "Kraftig regn i Gävle", ts(2021, 8, 20, 9), 2, "b"),
        (4, "Solen skiner", ts(2021, 8, 20, 9), 3, "c"),
        (5, "RT översvämning Uddevalla", ts(2021, 8, 21, 9), 4, "d"),
    ]
    return spark.createDataFrame(rows, "id long, text string, created_at timestamp, user_id long, name string")


def test_geoparse_evaluation(spark):
    posts = _posts(spark).withColumn("relevant", F.lit(1)).withColumn("mentions_location", (F.col("id") != 4).cast("int"))
    out = flows.geoparse_evaluation(posts, gz.sample_gazetteer(spark))
    m = out["metrics"].first()
    assert m["tp"] + m["tn"] + m["fp"] + m["fn"] == 5
    assert sum(r["n"] for r in out["confusion"].collect()) == 5


def test_train_and_locate(spark):
    a = _posts(spark).withColumn("relevant", (F.col("id") != 4).cast("int"))
    model, conf, metrics = flows.train_relevance([a, a], "relevant", seed=1)
    assert sum(r["n"] for r in conf.collect()) == metrics.first()["tp"] + metrics.first()["tn"] + metrics.first()["fp"] + metrics.first()["fn"]
    located = flows.locate_posts(_posts(spark), model, gz.sample_gazetteer(spark))
    for r in located.collect():
        assert r["loc_name"] in {"Uddevalla", "Ljungskile", "Gävle"}


def test_selection_views(spark):
    posts = _posts(spark).withColumn("loc_name", F.lit("Uddevalla")).withColumn("lon", F.lit(11.9)).withColumn("lat", F.lit(58.3))
    out = flows.selection_views(posts, {"ids": posts.filter("id < 3").select("id")})
    assert out["summary"].first()["selected"] == 2
    assert sum(r["n"] for r in out["histogram"].collect()) == 5
