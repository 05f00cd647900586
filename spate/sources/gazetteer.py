"""Gazetteer and region fixtures, and readers for real files.

The gazetteer is the dimension table behind toponym recognition (J3) and
resolution (J4): one row per place record,
``name, country_code, place_id, osm_type, osm_id, boundingbox array<string>
(south, north, west, east), lat string, lon string, display_name, class, type,
importance double``.  A real deployment reads a full gazetteer export with
``read_gazetteer``; the small sample below serves tests and the example queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

GAZETTEER_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("country_code", T.StringType()),
        T.StructField("place_id", T.LongType()),
        T.StructField("osm_type", T.StringType()),
        T.StructField("osm_id", T.LongType()),
        T.StructField("boundingbox", T.ArrayType(T.StringType())),
        T.StructField("lat", T.StringType()),
        T.StructField("lon", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("importance", T.DoubleType()),
    ]
)

# Sample records, hand-made to cover the location rules (country record, county
# name, duplicate name, foreign place, equal sizes, oversized box).
SAMPLE_GAZETTEER = [
    ("Uddevalla", "se", 14, "node", 212, ["58.30", "58.40", "11.85", "12.00"], "58.35", "11.92",
     "Uddevalla, Uddevalla kommun, Västra Götaland County, Sweden", "place", "town", 0.6),
    ("Ljungskile", "se", 15, "node", 213, ["58.20", "58.25", "11.90", "11.95"], "58.22", "11.92",
     "Ljungskile, Uddevalla kommun, Västra Götaland County, Sweden", "place", "village", 0.5),
    ("Sweden", "se", 1, "relation", 52822, ["55.0", "69.1", "10.9", "24.2"], "62.0", "15.0",
     "Sweden", "boundary", "administrative", 0.9),
    ("Västra Götalands Lan", "se", 2, "relation", 101, ["57.1", "59.3", "11.0", "14.6"], "58.2", "12.8",
     "Västra Götalands Lan, Sweden", "boundary", "administrative", 0.7),
    ("Gävle", "se", 3, "node", 201, ["60.6", "60.75", "17.0", "17.3"], "60.67", "17.14",
     "Gävle, Gävle kommun, Gävleborg County, Sweden", "place", "city", 0.65),
    ("Gävle", "se", 4, "node", 202, ["60.0", "61.0", "16.5", "17.5"], "60.5", "17.0",
     "Gävle, Gävleborg County, Sweden", "boundary", "administrative", 0.4),
    ("Göteborg", "se", 5, "node", 203, ["57.6", "57.8", "11.8", "12.1"], "57.7", "11.97",
     "Göteborg, Göteborgs kommun, Västra Götaland County, Sweden", "place", "city", 0.75),
    ("Stockholm", "se", 6, "node", 204, ["59.2", "59.45", "17.8", "18.2"], "59.33", "18.07",
     "Stockholm, Stockholms kommun, Stockholm County, Sweden", "place", "city", 0.8),
    ("Malmö", "se", 7, "node", 205, ["55.5", "55.65", "12.9", "13.1"], "55.6", "13.0",
     "Malmö, Malmö kommun, Skåne County, Sweden", "place", "city", 0.7),
    ("Uppsala", "se", 8, "node", 206, ["59.8", "59.9", "17.55", "17.75"], "59.86", "17.64",
     "Uppsala, Uppsala kommun, Uppsala County, Sweden", "place", "city", 0.68),
    ("Kiruna", "se", 9, "node", 207, ["67.8", "67.9", "20.15", "20.35"], "67.85", "20.23",
     "Kiruna, Kiruna kommun, Norrbotten County, Sweden", "place", "town", 0.55),
    ("Alberta", "ca", 10, "relation", 208, ["49.0", "60.0", "-120.0", "-110.0"], "55.0", "-115.0",
     "Alberta, Canada", "boundary", "administrative", 0.8),
    ("Lerum", "se", 11, "node", 209, ["57.75", "57.80", "12.25", "12.30"], "57.77", "12.27",
     "Lerum, Lerums kommun, Västra Götaland County, Sweden", "place", "town", 0.45),
    ("Alingsås", "se", 12, "node", 210, ["57.90", "57.95", "12.50", "12.55"], "57.93", "12.53",
     "Alingsås, Alingsås kommun, Västra Götaland County, Sweden", "place", "town", 0.46),
    ("Ocean", "se", 13, "relation", 211, ["-90.0", "90.0", "-180.0", "900.0"], "0.0", "0.0",
     "Ocean, Sweden", "natural", "water", 0.3),
]

# Names mentioned by the example toponym tables (including one that does not
# resolve and one outside the country).
SAMPLE_MENTIONS = [
    "Uddevalla", "Ljungskile", "Sweden", "Västra Götalands Lan", "Gävle", "Göteborg", "Stockholm",
    "Malmö", "Uppsala", "Kiruna", "Alberta", "Atlantis", "Lerum", "Alingsås", "Ocean",
]


def sample_gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE_GAZETTEER, GAZETTEER_SCHEMA)


def read_gazetteer(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A full gazetteer export with ``GAZETTEER_SCHEMA`` (parquet or JSON lines)."""
    reader = spark.read.schema(GAZETTEER_SCHEMA)
    return reader.parquet(path) if fmt == "parquet" else reader.json(path)


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, list):
        return "[" + ", ".join(_sql_lit(x) for x in v) + "]"
    if isinstance(v, float):
        return repr(v) + "::DOUBLE"
    return str(v)


def gazetteer_values_sql() -> str:
    """The sample gazetteer as a SQL ``VALUES`` relation (for the oracle)."""
    cols = ", ".join(f.name for f in GAZETTEER_SCHEMA.fields)
    rows = ",\n    ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in SAMPLE_GAZETTEER)
    return f"(VALUES\n    {rows}\n) AS g({cols})"
