"""Readers (S1–S4, S7, S9) and post assembly (J1, J2) on hand-written files."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from spate.sources import posts as src
from spate.sources import regions as rg


def _tmp(name, content):
    d = tempfile.mkdtemp(prefix="spate-test-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(content)
    return p


def test_read_post_map_flattens_top_level(spark):
    doc = {
        "1428506193014796289": {
            "id": "1428506193014796289",
            "text": "RT @x: vatten i Gävle",
            "created_at": "2021-08-19T23:56:31.000Z",
            "lang": "sv",
            "public_metrics": {"retweet_count": 10, "reply_count": 0, "like_count": 0, "quote_count": 0},
            "user": {"id": "7", "username": "u", "name": "n"},
        },
        "2": {"id": "2", "text": "regn", "created_at": "2021-08-20T01:00:00.000Z", "lang": "sv", "user": {"id": "8", "username": "v", "name": "m"}},
    }
    p = _tmp("posts.json", json.dumps(doc))
    df = src.read_post_map(spark, p)
    rows = {r["id"]: r for r in df.collect()}
    assert set(rows) == {1428506193014796289, 2}
    assert rows[2]["user"]["username"] == "v"
    assert str(rows[1428506193014796289]["created_at"]).startswith("2021-08-19 23:56:31")
    flat = src.flatten_user(df).select("id", "user_id", "user_username").collect()
    assert {r["user_id"] for r in flat} == {"7", "8"}


def test_read_annotated_drops_blank_labels(spark):
    doc = {
        "1": {"id": "1", "text": "a", "On Topic": "1", "Explicit location in Sweden": "0", "Contains specific information about IMPACTS": "1"},
        "2": {"id": "2", "text": "b", "On Topic": "", "Explicit location in Sweden": "0", "Contains specific information about IMPACTS": "1"},
    }
    df = src.read_annotated(spark, _tmp("ann.json", json.dumps(doc)))
    r = df.select("id", "relevant", "mentions_location", "mentions_impact").collect()
    assert [tuple(x) for x in r] == [(1, 1, 0, 1)]


def test_crisislex_and_crisis_tsv(spark):
    lex = _tmp("lex.csv", "tweet_id,tweet,label\n\"'123'\",flood now,on-topic\n\"'456'\",nice day,off-topic\n")
    got = {(r["id"], r["relevant"]) for r in src.read_crisislex(spark, lex).collect()}
    assert got == {(123, 1), (456, 0)}
    tsv = _tmp(
        "c.tsv",
        "event_name\ttweet_id\timage_id\ttweet_text\timage\tlabel\n"
        "e\t1\ti\tx\tim\tsevere_damage\ne\t2\ti\tx\tim\tsever_damage\ne\t3\ti\tx\tim\tmild_damage\ne\t4\ti\tx\tim\tlittle_or_no_damage\n",
    )
    got = {(r["id"], r["mentions_impact"]) for r in src.read_crisis_tsv(spark, tsv).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 0)}


def test_load_dispatch_rejects_unknown(spark):
    try:
        src.load(spark, "nope", "/x")
    except ValueError:
        return
    raise AssertionError("unknown kind accepted")


def test_legacy_stage_reader(spark):
    p = _tmp("stage.csv", 'id,user\n1,"{\'id\': 5, \'name\': None, \'ok\': True}"\n2,"{broken"\n')
    df = src.read_legacy_stage(spark, p, {"user": "struct<id:int,name:string,ok:boolean>"})
    rows = {r["id"]: r for r in df.collect()}
    assert rows["1"]["user"]["id"] == 5 and rows["1"]["user"]["ok"] is True and rows["1"]["user"]["name"] is None
    assert rows["2"]["user"] is None and rows["2"]["_unparsed"][0]["column"] == "user"


def test_legacy_stage_reader_keeps_quoted_constants(spark):
    p = _tmp("stage.csv", 'id,user\n1,"{\'id\': 5, \'name\': \'None the Wiser True\', \'ok\': False}"\n2,"{\'id\': None, \'name\': ""it\'s None"", \'ok\': None}"\n')
    rows = {r["id"]: r["user"] for r in src.read_legacy_stage(spark, p, {"user": "struct<id:int,name:string,ok:boolean>"}).collect()}
    assert rows["1"]["name"] == "None the Wiser True" and rows["1"]["ok"] is False
    assert rows["2"]["id"] is None and rows["2"]["name"] == "it's None" and rows["2"]["ok"] is None


def test_assemble_posts_repeated_dimension_rows_and_keys(spark):
    posts = spark.createDataFrame(
        [("1", "a", "1", {"place_id": "1"}, {"media_keys": ["m1", "m1"]}), ("2", "b", "1", None, {"media_keys": ["m1", None]})],
        "id string, text string, author_id string, geo struct<place_id:string>, attachments struct<media_keys:array<string>>",
    )
    users = spark.createDataFrame([("1", "old", "n"), ("1", "new", "n")], "id string, username string, name string").coalesce(1)
    places = spark.createDataFrame([("1", "p", "f"), ("1", "p2", "f")], "id string, name string, full_name string").coalesce(1)
    media = spark.createDataFrame([("m1", "photo", "u1"), ("m1", "photo", "u2")], "media_key string, type string, url string").coalesce(1)
    out, rejects = src.assemble_posts(posts, users, places, media)
    rows = out.collect()
    assert [(r["id"], r["user"]["username"], r["place"]["name"], r["media"]["m1"]["url"]) for r in rows] == [("1", "new", "p2", "u2")]
    assert [tuple(r) for r in rejects.collect()] == [("2", "missing media")]


def test_assemble_posts(spark):
    posts = spark.createDataFrame(
        [
            ("1", "This is a tweet", "1", {"place_id": "1"}, None),
            ("2", "no place", "1", None, {"media_keys": ["m1", "m2"]}),
            ("3", "poll", "1", None, {"media_keys": []}),
            ("4", "ghost author", "9", None, None),
        ],
        "id string, text string, author_id string, geo struct<place_id:string>, attachments struct<media_keys:array<string>>",
    )
    users = spark.createDataFrame([("1", "username", "name")], "id string, username string, name string")
    places = spark.createDataFrame([("1", "place1", "full_name1")], "id string, name string, full_name string")
    media = spark.createDataFrame([("m1", "photo", "u1"), ("m2", "video", "u2")], "media_key string, type string, url string")
    out, rejects = src.assemble_posts(posts, users, places, media)
    rows = {r["id"]: r for r in out.collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"]["place"]["full_name"] == "full_name1" and rows["1"]["geo"] is None
    assert rows["1"]["user"]["username"] == "username"
    assert set(rows["2"]["media"]) == {"m1", "m2"} and rows["2"]["attachments"] is None
    assert rows["3"]["attachments"] is not None  # polls stay
    assert [tuple(r) for r in rejects.collect()] == [("4", "missing user")]


def test_attach_labels_label_columns_win(spark):
    posts = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, text string, relevant int")
    labels = spark.createDataFrame([(1, 1)], "id long, relevant int")
    assert [tuple(r) for r in src.attach_labels(posts, labels).select("id", "text", "relevant").collect()] == [(1, "a", 1)]


def test_read_regions_polygon_and_multipolygon(spark):
    gj = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
            {
                "type": "Feature",
                "properties": {"name": "B"},
                "geometry": {"type": "MultiPolygon", "coordinates": [[[[2, 2], [3, 2], [3, 3], [2, 2]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]},
            },
        ],
    }
    df = rg.read_regions(spark, _tmp("r.geojson", json.dumps(gj)), level="counties")
    rows = sorted((r["name"], r["poly_no"], len(r["rings"][0])) for r in df.collect())
    assert rows == [("A", 0, 4), ("B", 0, 4), ("B", 1, 4)]
    assert df.filter(F.col("name") == "B").first()["rings"][0][0]["x"] == 2.0


def test_assemble_takes_the_largest_order(spark):
    posts = spark.createDataFrame([("1", "t", "7")], "id string, text string, author_id string").withColumn("geo", F.lit(None).cast("struct<place_id:string>"))
    users = spark.createDataFrame([("7", "new", 2), ("7", "old", 1), ("8", "x", 3)], "id string, username string, page int")
    places = spark.createDataFrame([], "id string, name string, page int")
    for n in (1, 3):
        out, rejects = src.assemble_posts(posts, users.repartition(n), places, order="page")
        assert out.first()["user"].asDict() == {"id": "7", "username": "new"} and rejects.count() == 0
