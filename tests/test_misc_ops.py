"""S8 stage writing, map-form location helpers (F7, F9, explode), J1 rejects,
F10 token filters, K2 sorting."""

import os
import tempfile

from pyspark.sql import functions as F

from spate.operators import clean, geo, views
from spate.sources import posts as src

LOCS = "map<string,struct<ner_score:double,loc:struct<place_id:long,display_name:string>>>"


def _locations(spark):
    rows = [
        (1, {"Gävle": {"ner_score": 0.9, "loc": {"place_id": 3, "display_name": "Gävle, Sweden"}}, "Atlantis": {"ner_score": 0.5, "loc": None}}),
        (2, {"Atlantis": {"ner_score": 0.4, "loc": None}}),
        (3, {}),
    ]
    return spark.createDataFrame(rows, f"id long, locations {LOCS}")


def test_map_form_location_helpers(spark):
    df = _locations(spark)
    has = {r["id"]: r["h"] for r in df.select("id", geo.has_location_map("locations").alias("h")).collect()}
    assert has == {1: True, 2: False, 3: False}
    assert {r["id"] for r in geo.mentions_any(df, ["Gävle", "Uppsala"]).collect()} == {1}
    ex = {(r["id"], r["word"], r["loc"]["place_id"] if r["loc"] else None) for r in geo.explode_locations(df).collect()}
    assert ex == {(1, "Gävle", 3), (1, "Atlantis", None), (2, "Atlantis", None)}


def test_write_stage_partitioned(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="spate-stage-"), "t")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id long, day string")
    src.write_stage(df, out, partition_by=["day"])
    back = spark.read.parquet(out)
    assert sorted((r["id"], str(r["day"])) for r in back.collect()) == [(1, "2024-01-01"), (2, "2024-01-02")]
    assert back.filter(F.col("day") == "2024-01-02").count() == 1


def test_assemble_rejects_missing_place_and_media(spark):
    posts = spark.createDataFrame(
        [("1", "a", "1", {"place_id": "9"}, None), ("2", "b", "1", None, {"media_keys": ["m9"]})],
        "id string, text string, author_id string, geo struct<place_id:string>, attachments struct<media_keys:array<string>>",
    )
    users = spark.createDataFrame([("1", "u", "n")], "id string, username string, name string")
    places = spark.createDataFrame([("1", "p", "f")], "id string, name string, full_name string")
    media = spark.createDataFrame([("m1", "photo", "u")], "media_key string, type string, url string")
    out, rejects = src.assemble_posts(posts, users, places, media)
    assert out.count() == 0
    assert sorted(map(tuple, rejects.collect())) == [("1", "missing place"), ("2", "missing media")]


def test_min_tokens_and_sort_table(spark):
    df = spark.createDataFrame([(1, ["a", "bb", "ccc"]), (2, ["x", "yy"])], "id long, tokens array<string>")
    got = {r["id"]: r["tokens"] for r in clean.min_tokens(df, min_len=2, min_words=1).collect()}
    assert got == {1: ["bb", "ccc"]}
    s = views.sort_table(spark.createDataFrame([(1, 3.0), (2, 1.0)], "id long, v double"), "v", desc=True)
    assert [r["id"] for r in s.collect()] == [1, 2]


def test_spread_only_when_scan_is_narrow(spark):
    from spate.plans import tables

    narrow = spark.range(0, 100, numPartitions=1)
    wide = spark.range(0, 100, numPartitions=64)
    target = spark.sparkContext.defaultParallelism * 2
    assert tables.spread(narrow).rdd.getNumPartitions() == target
    assert tables.spread(wide).rdd.getNumPartitions() == 64


def test_hardest_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, 1, 0.5), (1, 1, 0.5), (2, 1, 0.9), (4, 0, 2.0)], "id long, label int, loss double")
    assert [r["id"] for r in views.hardest(df, n=2).collect()] == [2, 1]
