"""Place names and coordinates.

J3 ``extract_toponyms`` (gazetteer phrase join), J4 ``resolve_toponyms``
(gazetteer lookup), A11 ``smallest_location``, A12 ``country_mentions``,
F13 ``flatten_location``, F7 ``mentions_any``, F9 ``has_location``,
``explode_locations``, A13 ``coordinate_rollup``, A14 ``grid_clusters``,
J5 ``points_in_regions`` / ``filter_region`` (grid-cell equi-join + exact
even-odd / on-edge test), A19 ``merge_subwords`` and A6 ``entity_counts`` for
token-classifier output.

Toponyms are kept in long form ``(id, pos, word, ner_score, loc struct)``: one
row per post × place name; ``loc`` is NULL when the name did not resolve.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spate.functions import text as tx
from spate.operators.groups import paged_lists, with_computed
from spate.session import cut_lineage

# ---------------------------------------------------------------------------
# Fixed values of the location choice.
# ---------------------------------------------------------------------------

# A display-name part meaning "county": such names are not places.
COUNTY_PART = "Lan"
# A first display-name part meaning the whole country.
COUNTRY_NAME = "Sweden"
# Start value of the smallest-size search: larger places never win.
MAX_PLACE_SIZE = 999.0

# Web-Mercator tile size in pixels at zoom 0.
TILE_PX = 256


# ---------------------------------------------------------------------------
# Expressions
# ---------------------------------------------------------------------------


def name_parts(display_name) -> Column:
    """Comma-separated parts of a display name, stripped (decision D8)."""
    c = F.col(display_name) if isinstance(display_name, str) else display_name
    return F.transform(F.split(c, ","), lambda p: F.trim(p))


def place_size(bbox) -> Column:
    """|south − north| + |west − east| of a string bounding box (degrees)."""
    b = F.col(bbox) if isinstance(bbox, str) else bbox
    d = [F.element_at(b, i).cast("double") for i in (1, 2, 3, 4)]
    return F.abs(d[0] - d[1]) + F.abs(d[2] - d[3])


def normalise_name(c) -> Column:
    """Case- and punctuation-insensitive key for gazetteer matching."""
    col = F.col(c) if isinstance(c, str) else c
    return F.trim(F.lower(F.translate(col, tx.PUNCTUATION, "")))


# ---------------------------------------------------------------------------
# Toponym recognition and resolution (re-aimed as gazetteer joins)
# ---------------------------------------------------------------------------


def gazetteer_names(gazetteer: DataFrame, country: str | None = None) -> DataFrame:
    """Best record per normalised name (highest importance, then smallest
    place_id), optionally limited to one country code."""
    g = gazetteer
    if country is not None:
        g = g.filter(F.upper(F.col("country_code")) == country.upper())
    g = g.withColumn("key", normalise_name("name")).filter(F.col("key") != "")
    loc_fields = [c for c in g.columns if c not in ("name", "key", "country_code")]
    best = g.groupBy("key").agg(
        F.max_by(F.struct(*loc_fields), F.struct(F.col("importance"), -F.col("place_id"))).alias("loc")
    )
    return best


# Bits of the filter of whole names: so many a name, and at most 32 MB; more names than that are thinned less.
_NAME_BITS, _LEAST_BITS, _MOST_BITS = 16, 1 << 16, 1 << 28
_CELL = 1 << 15
# Posts whose phrases are looked up at once.
_POSTS = 1_000


def _word_key(w: Column) -> Column:
    return F.lower(F.translate(w, tx.PUNCTUATION, ""))


def _phrase_bits(words: np.ndarray, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two filter bits of each phrase of ``n`` words from ``at`` on, by the hashes of its words."""
    x = np.full(len(at), n, dtype=np.uint64)
    for j in range(n):
        x = (x ^ words[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return (x & np.uint64(bits - 1)).astype(np.int64), (x >> np.uint64(32) & np.uint64(bits - 1)).astype(np.int64)


def _word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of a column of lists, and the number of words of each list (null: none)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), sizes


def name_filter(names: DataFrame) -> np.ndarray:
    """A Bloom filter of the names ``(key, n)`` for ``_phrase_bits``, as a packed bitmap of a size that follows their number."""
    bits = _LEAST_BITS
    while bits < min(_NAME_BITS * names.count(), _MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = _word_hashes(batch.column(0))
            starts = np.cumsum(sizes) - sizes
            for n in np.unique(sizes[sizes > 0]):
                found = np.concatenate(_phrase_bits(words, starts[sizes == n], int(n), bits))
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["p"])

    hashes = names.select(F.transform(F.split("key", " "), lambda w: F.xxhash64(w)).alias("h"))
    cells = hashes.mapInArrow(run, "p long").groupBy(F.floor(F.col("p") / _CELL).cast("int").alias("cell")).agg(
        F.collect_set(F.pmod("p", F.lit(_CELL)).cast("int")).alias("bits")
    )
    table = np.zeros(bits, dtype=bool)
    for row in cells.toLocalIterator():  # at most ``_CELL`` numbers a row
        table[row["cell"] * _CELL + np.asarray(row["bits"], dtype=np.int64)] = True
    return np.packbits(table)


def _set(table: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (table[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)


def possible_names(words: np.ndarray, sizes: np.ndarray, lengths: list[int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of ``lengths`` words that lie in one post and pass the filter: index of the first word, and length."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(words))
    at, long = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in lengths:
        start = np.flatnonzero(left >= n)
        one, two = _phrase_bits(words, start, n, 8 * len(table))
        start = start[_set(table, one) & _set(table, two)]
        at.append(start)
        long.append(np.full(len(start), n))
    at, long = np.concatenate(at), np.concatenate(long)
    order = np.argsort(at, kind="stable")
    return at[order], long[order]


def _with_possible_names(src: DataFrame, lengths: list[int], table: np.ndarray) -> DataFrame:
    """``src`` (id, ws, keys, h) with ``hits`` (pos, n) in place of the hashes ``h`` of the keys."""
    shared = src.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*src.schema.fields[:3], T.StructField("hits", T.ArrayType(T.StructType.fromDDL("pos int, n int")))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, _POSTS) for k in range(0, batch.num_rows, _POSTS)):
                words, sizes = _word_hashes(part.column(3))
                at, n = possible_names(words, sizes, lengths, shared.value)
                ends = np.cumsum(sizes)
                post = np.searchsorted(ends, at, side="right")
                pos = at - (ends - sizes)[post]
                hits = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(n, pa.int32())], names=["pos", "n"])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(post, minlength=part.num_rows))])
                hits = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), hits], names=["id", "ws", "keys", "hits"])

    return src.mapInArrow(run, schema)


def name_words(gazetteer: DataFrame, country: str | None = None) -> DataFrame:
    """``(key, first, n)``: every name as its words joined by one space, its first word, and its number of words."""
    words = gazetteer_names(gazetteer, country).select(tx.split_words("key").alias("w")).filter(F.size("w") > 0)
    return words.select(F.array_join("w", " ").alias("key"), F.col("w")[0].alias("first"), F.size("w").alias("n")).distinct()


def extract_toponyms(posts: DataFrame, gazetteer: DataFrame, id: str = "id", text: str = "text", country: str | None = None) -> DataFrame:
    """Place names in the text, found as phrases equal word by word (case/punctuation-insensitive)
    to a gazetteer name of any number of words.  Noise is removed with numbers kept.
    A post does not send every phrase: a filter of the whole names, whose size follows their number,
    thins them inside the scan; a join on the whole name decides.  Overlaps resolve from left to right: at each start the
    longest name counts, and it is taken unless it overlaps the one taken before it.
    Output ``(id, pos, word)``: one row per post × distinct word, at its first place."""
    names = cut_lineage(name_words(gazetteer, country))
    lengths = sorted(r["n"] for r in names.select("n").distinct().collect())  # at most the words of the longest name

    src = with_computed(posts.select(F.col(id).alias("id"), F.col(text).alias("text")), "ws", tx.split_words(tx.strip_noise(F.col("text"), numbers=False)))
    src = with_computed(src.select("id", "ws"), "keys", F.transform("ws", _word_key))
    src = _with_possible_names(src.withColumn("h", F.transform("keys", lambda k: F.xxhash64(k))), lengths, name_filter(names))
    part = lambda words, x: F.array_join(F.slice(words, x["pos"] + 1, x["n"]), " ")
    hits = F.transform("hits", lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"), part("keys", x).alias("key"), part("ws", x).alias("phrase")))
    # A phrase that is its own key travels once.
    phrase = src.select("id", F.explode(hits).alias("x")).select("id", "x.pos", "x.n", "x.key", F.nullif("x.phrase", "x.key").alias("other"))
    found = phrase.join(names.select("key"), "key", "left_semi").select("id", "pos", "n", F.coalesce("other", "key").alias("phrase"))
    # Dealt out by post once, for all that follows.  At a start the longest comes first, and those after it overlap it.
    per_post = found.repartition("id").groupBy("id").agg(F.collect_list(F.struct("pos", (-F.col("n")).alias("less"), "n", "phrase")).alias("hits"))
    per_post = per_post.select("id", F.array_sort("hits").alias("hits"))
    kept = F.aggregate(
        "hits",
        F.struct(F.lit(0).alias("reach"), F.slice("hits", 1, 0).alias("taken")),
        lambda acc, h: F.when(
            h["pos"] >= acc["reach"],
            F.struct((h["pos"] + h["n"]).alias("reach"), F.concat(acc["taken"], F.array(h)).alias("taken")),
        ).otherwise(acc),
        lambda acc: acc["taken"],
    )
    taken = per_post.select("id", F.explode(kept).alias("h"))
    return taken.groupBy("id", F.col("h.phrase").alias("word")).agg(F.min("h.pos").alias("pos")).select("id", "pos", "word")


def resolve_toponyms(toponyms: DataFrame, gazetteer: DataFrame, country: str | None = "SE", word: str = "word") -> DataFrame:
    """Attach the best gazetteer record (``loc`` struct) to every toponym;
    unresolved names are kept with ``loc`` NULL."""
    best = gazetteer_names(gazetteer, country)
    return toponyms.withColumn("key", normalise_name(word)).join(best, "key", "left").drop("key")


def smallest_location(toponyms: DataFrame, id: str = "id", loc: str = "loc", pos: str = "pos") -> DataFrame:
    """Per post the resolved place with the smallest bounding box
    (|Δlat| + |Δlon|).  Skipped: unresolved names, county names (a ``Lan``
    part), the country itself (first part ``Sweden``) and sizes ≥ 999.  Ties go
    to the earlier toponym.  Posts without a candidate are absent.
    Output ``(id, loc)``."""
    parts = name_parts(F.col(f"{loc}.display_name"))
    cand = toponyms.filter(
        F.col(loc).isNotNull()
        & ~F.array_contains(parts, COUNTY_PART)
        & (F.element_at(parts, 1) != COUNTRY_NAME)
    ).withColumn("__size", place_size(F.col(f"{loc}.boundingbox")))
    cand = cand.filter(F.col("__size") < MAX_PLACE_SIZE)
    return cand.groupBy(id).agg(F.min_by(F.col(loc), F.struct("__size", pos)).alias(loc))


def country_mentions(toponyms: DataFrame, loc: str = "loc") -> DataFrame:
    """Number of toponyms resolving to the country itself (per toponym)."""
    parts = name_parts(F.col(f"{loc}.display_name"))
    return toponyms.agg(
        F.count_if(
            F.col(loc).isNotNull()
            & ~F.array_contains(parts, COUNTY_PART)
            & (F.element_at(parts, 1) == COUNTRY_NAME)
        ).alias("country_mentions")
    )


def flatten_location(df: DataFrame, loc: str = "loc") -> DataFrame:
    """chosen location as columns; ``loc_name`` = display name before the
    first comma; lat/lon as doubles."""
    others = [c for c in df.columns if c != loc]
    return df.select(
        *others,
        F.col(f"{loc}.class").alias("class"),
        F.col(f"{loc}.importance").alias("importance"),
        F.col(f"{loc}.type").alias("type"),
        F.col(f"{loc}.display_name").alias("display_name"),
        F.col(f"{loc}.lat").cast("double").alias("lat"),
        F.col(f"{loc}.lon").cast("double").alias("lon"),
        F.col(f"{loc}.boundingbox").alias("boundingbox"),
        F.substring_index(F.col(f"{loc}.display_name"), ",", 1).alias("loc_name"),
    )


def has_location(toponyms: DataFrame, id: str = "id", loc: str = "loc") -> DataFrame:
    """F9 (long form): per post whether any toponym resolved."""
    return toponyms.groupBy(id).agg(F.max(F.col(loc).isNotNull()).alias("has_location"))


def has_location_map(locations) -> Column:
    """F9 (map form): any value of a ``word -> struct(loc ...)`` map resolved."""
    c = F.col(locations) if isinstance(locations, str) else locations
    return F.coalesce(F.exists(F.map_values(c), lambda v: v["loc"].isNotNull()), F.lit(False))


def mentions_any(df: DataFrame, names, locations: str = "locations") -> DataFrame:
    """posts whose location-name map shares a key with ``names``."""
    return df.filter(F.arrays_overlap(F.map_keys(F.col(locations)), F.array(*[F.lit(n) for n in names])))


def explode_locations(df: DataFrame, locations: str = "locations", id: str = "id") -> DataFrame:
    """One row per post × location of a map column (long form)."""
    return df.select(F.col(id), F.explode(F.map_entries(F.col(locations))).alias("e")).select(
        id, F.col("e.key").alias("word"), F.col("e.value.ner_score").alias("ner_score"), F.col("e.value.loc").alias("loc")
    )


def coordinate_rollup(df: DataFrame, id: str = "id", lon: str = "lon", lat: str = "lat", extra=("loc_name",)) -> DataFrame:
    """Per exact coordinate the number of posts and the first (smallest
    id) post's id and fields."""
    first = F.min_by(F.struct(F.col(id).alias("id"), *[F.col(c) for c in extra]), F.col(id))
    return df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).groupBy(lon, lat).agg(
        F.count(F.lit(1)).alias("n"), first.alias("first")
    ).select(lon, lat, "n", F.col("first.id").alias("first_id"), *[F.col(f"first.{c}").alias(c) for c in extra])


def mercator_pixels(lon, lat, zoom: int) -> tuple[Column, Column]:
    """World pixel coordinates of (lon, lat) at ``zoom`` (Web Mercator)."""
    size = float(TILE_PX * (2 ** zoom))
    lo = F.col(lon) if isinstance(lon, str) else lon
    la = F.col(lat) if isinstance(lat, str) else lat
    x = (lo + F.lit(180.0)) / F.lit(360.0) * F.lit(size)
    r = F.radians(la)
    y = (F.lit(1.0) - F.log(F.tan(r) + F.lit(1.0) / F.cos(r)) / F.lit(math.pi)) / F.lit(2.0) * F.lit(size)
    return x, y


def grid_clusters(df: DataFrame, zoom: int, px: int = 50, id: str = "id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Marker clusters as a grid aggregate: points in the same ``px``-pixel
    cell at ``zoom`` form a cluster with its size, mean position and first id."""
    x, y = mercator_pixels(lon, lat, zoom)
    return (
        df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
        .select(id, lon, lat, F.floor(x / px).alias("cx"), F.floor(y / px).alias("cy"))
        .groupBy("cx", "cy")
        .agg(
            F.count(F.lit(1)).alias("n"),
            # means from integer micro-degrees: exact sums, independent of the
            # order partial aggregates are merged in
            (F.sum(F.round(F.col(lon) * F.lit(1e6)).cast("long")) / F.count(F.lit(1)) / F.lit(1e6)).alias("lon"),
            (F.sum(F.round(F.col(lat) * F.lit(1e6)).cast("long")) / F.count(F.lit(1)) / F.lit(1e6)).alias("lat"),
            F.min(id).alias("first_id"),
        )
    )


def cluster_posts(df: DataFrame, zoom: int, px: int = 50, id: str = "id", lon: str = "lon", lat: str = "lat", size: int = 1000) -> DataFrame:
    """The ids of each cluster of ``grid_clusters``, ascending, in pages of at most ``size``:
    ``(cx, cy, page, n, posts array<struct<id>>)``."""
    x, y = mercator_pixels(lon, lat, zoom)
    cells = df.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.col(id), F.floor(x / px).alias("cx"), F.floor(y / px).alias("cy"))
    return paged_lists(cells, ["cx", "cy"], [id], [id], size)


# ---------------------------------------------------------------------------
# Point in region
# ---------------------------------------------------------------------------


def _ring_hits(ring: Column, px: Column, py: Column) -> Column:
    """(crossings, on_edge) of the point against one closed ring."""
    idx = F.sequence(F.lit(1), F.size(ring) - 1)

    def edge(i):
        a = F.element_at(ring, i)
        b = F.element_at(ring, i + 1)
        return a, b

    def crosses(i):
        a, b = edge(i)
        x1, y1, x2, y2 = a["x"], a["y"], b["x"], b["y"]
        straddles = (y1 > py) != (y2 > py)
        xint = (x2 - x1) * (py - y1) / (y2 - y1) + x1
        # Nested CASE: the division only runs for straddling (non-flat) edges.
        return F.when(straddles, F.when(px < xint, 1).otherwise(0)).otherwise(0)

    def on_edge(i):
        a, b = edge(i)
        x1, y1, x2, y2 = a["x"], a["y"], b["x"], b["y"]
        cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
        within = (px >= F.least(x1, x2)) & (px <= F.greatest(x1, x2)) & (py >= F.least(y1, y2)) & (py <= F.greatest(y1, y2))
        return (cross == 0) & within

    n_cross = F.aggregate(F.transform(idx, crosses), F.lit(0), lambda acc, v: acc + v)
    touch = F.exists(idx, on_edge)
    return n_cross, touch


def point_in_polygon(rings: Column, px: Column, py: Column) -> Column:
    """Point inside a polygon (outer ring + holes) or on its boundary: even-odd
    crossings over all rings, or on any edge."""
    per_ring = F.transform(rings, lambda r: F.struct(*[c.alias(n) for c, n in zip(_ring_hits(r, px, py), ("c", "t"))]))
    total = F.aggregate(per_ring, F.lit(0), lambda acc, v: acc + v["c"])
    touch = F.exists(per_ring, lambda v: v["t"])
    return touch | (F.pmod(total, F.lit(2)) == 1)


def region_cells(regions: DataFrame, cell: float) -> DataFrame:
    """Explode each region polygon's bounding box into grid cells."""
    pts = F.flatten(F.col("rings"))
    xs = F.transform(pts, lambda p: p["x"])
    ys = F.transform(pts, lambda p: p["y"])
    b = regions.select(
        "*",
        F.floor(F.array_min(xs) / cell).cast("long").alias("x0"),
        F.floor(F.array_max(xs) / cell).cast("long").alias("x1"),
        F.floor(F.array_min(ys) / cell).cast("long").alias("y0"),
        F.floor(F.array_max(ys) / cell).cast("long").alias("y1"),
    )
    return (
        b.withColumn("cx", F.explode(F.sequence("x0", "x1")))
        .withColumn("cy", F.explode(F.sequence("y0", "y1")))
        .drop("x0", "x1", "y0", "y1")
    )


def points_in_regions(points: DataFrame, regions: DataFrame, cell: float = 0.5, id: str = "id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Inner join of points with the regions that contain them (boundary
    included).  A grid-cell equi-join finds candidates (a point lies in one
    cell; a polygon covers the cells of its bounding box), then the exact test
    runs on the candidates only.  Adds ``region_level`` and ``region_name``;
    a point inside several parts of a multipolygon appears once."""
    cells = region_cells(regions, cell).select(
        "cx", "cy", F.col("level").alias("region_level"), F.col("name").alias("region_name"), "rings"
    )
    keyed = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn(
        "cx", F.floor(F.col(lon) / cell).cast("long")
    ).withColumn("cy", F.floor(F.col(lat) / cell).cast("long"))
    # A point lying exactly on a cell border belongs to one cell only, but a
    # polygon edge on that border has its bbox reaching into it: covered,
    # because the bbox cells are inclusive of both floor values.
    cand = keyed.join(cells, ["cx", "cy"])
    hit = cand.filter(point_in_polygon(F.col("rings"), F.col(lon), F.col(lat)))
    cols = [c for c in points.columns]
    return hit.select(*cols, "region_level", "region_name").dropDuplicates([id, "region_level", "region_name"])


def filter_region(points: DataFrame, regions: DataFrame, name: str | None, cell: float = 0.5, id: str = "id") -> DataFrame:
    """J5 selection: posts inside region ``name``; no region → all rows."""
    if name is None:
        return points
    chosen = regions.filter(F.col("name") == name)
    inside = points_in_regions(points, chosen, cell=cell, id=id)
    return points.join(inside.select(id).distinct(), id, "left_semi")


# ---------------------------------------------------------------------------
# Token-classifier output
# ---------------------------------------------------------------------------


def merge_subwords(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Glue word pieces (``##…``) to the previous token, which keeps its
    entity, score, start and index (its end becomes the last piece's end);
    then drop tokens labelled ``O``.  A leading piece starts its own token.

    Linear and inside each row (no shuffle): the positions where a new token
    starts are found first, and every merged token is built from the slice of
    pieces up to the next start — each piece is read once.
    """
    t = F.col(tokens)
    n = F.size(t)
    starts = F.filter(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (i == 1) | ~F.element_at(t, i)["word"].startswith("##"),
    )
    starts = F.when(n > 0, starts).otherwise(F.array().cast("array<int>"))

    def merged(s, k):
        nxt = F.coalesce(F.try_element_at(starts, k + 2), n + 1)
        group = F.slice(t, s, nxt - s)
        head = F.element_at(t, s)
        rest = F.slice(group, 2, F.greatest(nxt - s - 1, F.lit(0)))
        word = F.concat(
            head["word"],
            F.array_join(F.transform(rest, lambda p: F.substr(p["word"], F.lit(3))), ""),
        )
        return F.struct(
            head["entity"].alias("entity"),
            word.alias("word"),
            head["score"].alias("score"),
            head["start"].alias("start"),
            F.element_at(group, -1)["end"].alias("end"),
            head["index"].alias("index"),
        )

    out = F.transform(starts, merged)
    return df.withColumn(tokens, F.filter(out, lambda x: x["entity"] != "O"))


def entity_label(entity) -> Column:
    """Entity label without a ``B-``/``I-`` prefix (decision D10)."""
    c = F.col(entity) if isinstance(entity, str) else entity
    return F.regexp_replace(c, "^[BI]-", "")


def location_tokens(df: DataFrame, tokens: str = "tokens", id: str = "id") -> DataFrame:
    """Location tokens of merged classifier output as long-form toponyms
    ``(id, pos, word, ner_score)``; a repeated word keeps its first place and
    the score of its last."""
    e = df.select(F.col(id), F.posexplode(F.col(tokens)).alias("pos", "t")).filter(entity_label(F.col("t.entity")) == "LOC")
    return e.groupBy(id, F.col("t.word").alias("word")).agg(
        F.min("pos").alias("pos"), F.max_by(F.col("t.score"), "pos").alias("ner_score")
    ).select(id, "pos", "word", "ner_score")


def entity_counts(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(entity, word, count)`` over all tokens."""
    e = df.select(F.explode(F.col(tokens)).alias("t"))
    return e.groupBy(entity_label(F.col("t.entity")).alias("entity"), F.col("t.word").alias("word")).agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy(F.col("count").desc(), "entity", "word")
