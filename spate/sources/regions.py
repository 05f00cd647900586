"""Region polygons (S9): GeoJSON reader and a sample.

Regions are one row per polygon: ``level, name, poly_no, rings
array<array<struct<x double, y double>>>`` — the outer ring first, holes after;
a MultiPolygon becomes several rows with the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RINGS = T.ArrayType(T.ArrayType(POINT))
REGION_SCHEMA = T.StructType(
    [
        T.StructField("level", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("poly_no", T.IntegerType()),
        T.StructField("rings", RINGS),
    ]
)


def _rect(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


# Hand-made sample regions: a county with a hole, a county with a slanted
# edge, a two-part county (multipolygon) and a triangular municipality.
SAMPLE_REGIONS = [
    ("counties", "South", 0, [_rect(11.0, 55.0, 16.0, 59.0), _rect(12.0, 56.0, 13.0, 57.0)]),
    ("counties", "Middle", 0, [[(16.0, 55.0), (20.0, 55.0), (20.0, 62.0), (14.0, 62.0), (16.0, 55.0)]]),
    ("counties", "North", 0, [_rect(17.0, 63.0, 24.0, 69.0)]),
    ("counties", "North", 1, [_rect(11.0, 63.0, 14.0, 65.0)]),
    ("municipalities", "Isle", 0, [[(18.0, 56.0), (19.0, 56.0), (18.5, 57.5), (18.0, 56.0)]]),
]


def sample_regions(spark: SparkSession) -> DataFrame:
    rows = [(lvl, name, no, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for lvl, name, no, rings in SAMPLE_REGIONS]
    return spark.createDataFrame(rows, REGION_SCHEMA)


def regions_values_sql() -> str:
    """The sample regions as a SQL relation ``(level, name, poly_no, rings)``."""

    def ring_sql(ring):
        return "[" + ", ".join(f"{{'x': {x!r}::DOUBLE, 'y': {y!r}::DOUBLE}}" for x, y in ring) + "]"

    rows = []
    for lvl, name, no, rings in SAMPLE_REGIONS:
        rings_sql = "[" + ", ".join(ring_sql(r) for r in rings) + "]"
        rows.append(f"('{lvl}', '{name}', {no}, {rings_sql})")
    return "(VALUES\n    " + ",\n    ".join(rows) + "\n) AS r(level, name, poly_no, rings)"


_GEOJSON_SCHEMA = T.StructType(
    [
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [
                                    T.StructField("type", T.StringType()),
                                    # kept as text: its depth depends on the type
                                    T.StructField("coordinates", T.StringType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        )
    ]
)


def read_regions(spark: SparkSession, path: str, level: str, name_prop: str = "name") -> DataFrame:
    """Read a GeoJSON FeatureCollection of Polygon / MultiPolygon features.

    Coordinates are read as text and parsed by geometry type, so mixed files
    keep the right nesting depth.  Output: one row per polygon.
    """
    raw = spark.read.schema(_GEOJSON_SCHEMA).option("multiLine", "true").json(path)
    feats = raw.select(F.explode("features").alias("f")).select(
        F.col("f.properties").getItem(name_prop).alias("name"),
        F.col("f.geometry.type").alias("gtype"),
        F.col("f.geometry.coordinates").alias("coords"),
    )
    poly = F.from_json("coords", "array<array<array<double>>>")
    multi = F.from_json("coords", "array<array<array<array<double>>>>")
    polys = F.when(F.col("gtype") == "Polygon", F.array(poly)).when(F.col("gtype") == "MultiPolygon", multi)
    exploded = feats.select("name", F.posexplode(polys).alias("poly_no", "p"))
    rings = F.transform(
        F.col("p"),
        lambda ring: F.transform(ring, lambda xy: F.struct(F.element_at(xy, 1).alias("x"), F.element_at(xy, 2).alias("y"))),
    )
    return exploded.select(F.lit(level).alias("level"), "name", F.col("poly_no").cast("int"), rings.alias("rings"))
