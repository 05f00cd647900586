"""Readers and sinks for post data (S1–S8) and the post assembly joins.

Schemas are explicit ``StructType``s — nothing is inferred on read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S = T.StringType()

USER = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("username", S),
        T.StructField("name", S),
        T.StructField("location", S),
        T.StructField("verified", T.BooleanType()),
        T.StructField("protected", T.BooleanType()),
        T.StructField("created_at", S),
    ]
)
PLACE = T.StructType([T.StructField("id", S), T.StructField("name", S), T.StructField("full_name", S), T.StructField("country_code", S), T.StructField("place_type", S)])
MEDIA = T.StructType([T.StructField("media_key", S), T.StructField("type", S), T.StructField("url", S)])
METRICS = T.StructType([T.StructField(n, T.LongType()) for n in ("retweet_count", "reply_count", "like_count", "quote_count")])

# One post as stored in a post-id → post JSON object.
POST = T.StructType(
    [
        T.StructField("id", S),
        T.StructField("text", S),
        T.StructField("created_at", S),
        T.StructField("lang", S),
        T.StructField("conversation_id", S),
        T.StructField("public_metrics", METRICS),
        T.StructField("referenced_tweets", T.ArrayType(T.StructType([T.StructField("type", S), T.StructField("id", S)]))),
        T.StructField("user", USER),
        T.StructField("place", PLACE),
        T.StructField("geo", T.StructType([T.StructField("place_id", S)])),
        T.StructField("media", T.MapType(S, MEDIA)),
    ]
)

# Annotation columns of the hand-labelled sets and their names here.
ANNOTATION_COLUMNS = {
    "On Topic": "relevant",
    "Explicit location in Sweden": "mentions_location",
    "Contains specific information about IMPACTS": "mentions_impact",
}

# Crisis image-text labels that count as impact (both spellings, decision D6).
IMPACT_LABELS = ("severe_damage", "sever_damage", "mild_damage")
ON_TOPIC = "on-topic"

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSX"


def _post_frame(raw: DataFrame, value_type: T.DataType) -> DataFrame:
    m = F.from_json(F.col("value"), T.MapType(S, value_type))
    rows = raw.select(F.explode(m).alias("key", "p")).select("p.*")
    return rows


def read_post_map(spark: SparkSession, path: str, schema: T.StructType = POST) -> DataFrame:
    """Files holding ONE JSON object ``{post_id: post, ...}``: each value
    becomes a row (top level flattened), ``id`` cast to long, ``created_at`` to
    a timestamp.  Files are read whole (one task per file — such files are
    page-sized); large collections should be JSON Lines (``read_post_lines``)."""
    raw = spark.read.option("wholetext", "true").text(path)
    df = _post_frame(raw, schema)
    out = df.withColumn("id", F.col("id").cast("long"))
    if "created_at" in df.columns:
        out = out.withColumn("created_at", F.to_timestamp("created_at", TIME_FORMAT))
    return out


def read_post_lines(spark: SparkSession, path: str, schema: T.StructType = POST) -> DataFrame:
    """S1 at scale: one post per line (JSON Lines), split across tasks."""
    df = spark.read.schema(schema).json(path)
    return df.withColumn("id", F.col("id").cast("long")).withColumn("created_at", F.to_timestamp("created_at", TIME_FORMAT))


def annotated_schema(base: T.StructType = POST) -> T.StructType:
    fields = list(base.fields) + [T.StructField(k, S) for k in ANNOTATION_COLUMNS]
    return T.StructType(fields)


def read_annotated(spark: SparkSession, path: str) -> DataFrame:
    """A post map with the three annotation columns (``"0"``, ``"1"`` or
    ``""``): renamed, rows with any blank annotation dropped, cast to int."""
    df = read_post_map(spark, path, annotated_schema())
    df = df.withColumnsRenamed(ANNOTATION_COLUMNS)
    cols = list(ANNOTATION_COLUMNS.values())
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


CRISISLEX_SCHEMA = T.StructType([T.StructField("tweet_id", S), T.StructField("tweet", S), T.StructField("label", S)])


def read_crisislex(spark: SparkSession, path: str) -> DataFrame:
    """S3: CSV ``tweet_id,tweet,label``; the id value carries one wrapping
    character at each end (stripped); ``relevant = label == "on-topic"``."""
    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema(CRISISLEX_SCHEMA).csv(path)
    return df.select(
        F.expr("substring(tweet_id, 2, length(tweet_id) - 2)").cast("long").alias("id"),
        F.col("tweet").alias("text"),
        (F.col("label") == ON_TOPIC).cast("int").alias("relevant"),
    )


CRISIS_TSV_SCHEMA = T.StructType([T.StructField(n, S) for n in ("event_name", "tweet_id", "image_id", "tweet_text", "image", "label")])


def read_crisis_tsv(spark: SparkSession, path: str, impact_labels=IMPACT_LABELS) -> DataFrame:
    """TSV ``event_name, tweet_id, image_id, tweet_text, image, label``;
    ``mentions_impact = label ∈ impact_labels``."""
    df = spark.read.option("header", "true").option("sep", "\t").schema(CRISIS_TSV_SCHEMA).csv(path)
    return df.select(
        "event_name",
        F.col("tweet_id").cast("long").alias("id"),
        "image_id",
        F.col("tweet_text").alias("text"),
        "image",
        F.col("label").isin(list(impact_labels)).cast("int").alias("mentions_impact"),
    )


def read_labels(spark: SparkSession, path: str, label_columns=("relevant", "mentions_impact", "mentions_location")) -> DataFrame:
    """CSV ``id, <label columns>``."""
    schema = T.StructType([T.StructField("id", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in label_columns])
    return spark.read.option("header", "true").schema(schema).csv(path)


LOADERS = {
    "posts": read_post_map,
    "annotated": read_annotated,
    "crisislex": read_crisislex,
    "crisis": read_crisis_tsv,
    "labels": read_labels,
}


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Loader chosen by an explicit data-set kind; unknown kinds error."""
    if kind not in LOADERS:
        raise ValueError(f"{kind} data set kind is not supported")
    return LOADERS[kind](spark, path)


# A quoted string with escapes, a bare word, what lies between, or an unmatched quote.
_REPR_PIECE = r"""'[^'\\]*+(?:\\.[^'\\]*+)*+'|"[^"\\]*+(?:\\.[^"\\]*+)*+"|\w++|[^'"\w]++|['"]"""


def _json_words(cell: Column) -> Column:
    """A Python ``repr`` with its constants as JSON writes them; quoted strings stay as they are."""
    words = {"None": "null", "True": "true", "False": "false"}

    def piece(p):
        out = p
        for python, json in words.items():
            out = F.when(p == python, json).otherwise(out)
        return out

    return F.array_join(F.transform(F.regexp_extract_all(cell, F.lit(_REPR_PIECE), F.lit(0)), piece), "")


def read_legacy_stage(spark: SparkSession, path: str, nested: dict[str, T.DataType]) -> DataFrame:
    """A CSV stage table whose nested cells are Python ``repr`` strings.

    ``None``/``True``/``False`` outside quotes are rewritten to JSON, then the
    cell is parsed with single quotes allowed.  Cells that still do not parse land in
    ``_unparsed`` (column name → raw text), never silently dropped."""
    from pyspark.sql.types import _parse_datatype_string

    df = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    errors = []
    for col, dtype in nested.items():
        dt = _parse_datatype_string(dtype) if isinstance(dtype, str) else dtype
        fixed = _json_words(F.col(col))
        opts = {"allowSingleQuotes": "true"}
        if isinstance(dt, T.StructType):
            # A malformed cell fills the corrupt-record field instead of the struct.
            probe = T.StructType(list(dt.fields) + [T.StructField("_corrupt", S)])
            opts["columnNameOfCorruptRecord"] = "_corrupt"
            parsed = F.from_json(fixed, probe, opts)
            bad = parsed["_corrupt"].isNotNull()
            value = F.when(~bad, F.struct(*[parsed[f.name].alias(f.name) for f in dt.fields]))
        else:
            value = F.from_json(fixed, dt, opts)
            bad = value.isNull()
        df = df.withColumn(f"__raw_{col}", F.col(col)).withColumn(f"__bad_{col}", bad & F.col(col).isNotNull()).withColumn(col, value)
        errors.append(F.when(F.col(f"__bad_{col}"), F.struct(F.lit(col).alias("column"), F.col(f"__raw_{col}").alias("text"))))
    df = df.withColumn("_unparsed", F.filter(F.array(*errors), lambda e: e.isNotNull()))
    return df.drop(*[f"__raw_{c}" for c in nested], *[f"__bad_{c}" for c in nested])


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write a stage table as Parquet (optionally partitioned, e.g. by day)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


# ---------------------------------------------------------------------------
# J1, J2, F12
# ---------------------------------------------------------------------------


def _last_rows(df: DataFrame, key: str, key_as: str, row_as: str, order: str | None = None) -> DataFrame:
    """One struct per key: the row with the largest ``order``, of equals (or without it) the last row of the table as it
    is read (partial ``max_by``; a hot key is combined map-side)."""
    at = [F.monotonically_increasing_id().alias("at")]
    return (
        df.select(
            F.col(key).alias(key_as), F.struct(*[F.col(c) for c in df.columns if c != order]).alias("__row"),
            F.struct(*([F.col(order).alias("order")] if order else []), *at).alias("__at"),
        )
        .groupBy(key_as).agg(F.max_by("__row", "__at").alias(row_as))
    )


def assemble_posts(posts: DataFrame, users: DataFrame, places: DataFrame, media: DataFrame | None = None, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Denormalise a search page.

    ``posts(id, text, author_id, geo struct<place_id>, attachments
    struct<media_keys array<string>>, ...)`` ⋈ ``users(id, ...)`` on the author
    (must exist; ``author_id`` dropped) ⟕ ``places(id, ...)`` on
    ``geo.place_id`` (``geo`` dropped when matched, kept otherwise) ⟕ ``media``
    by each media key (a ``media`` map; ``attachments`` dropped only when it
    has media keys, so polls stay).  Of users, places or media with the same
    id the row with the largest ``order`` counts (a column of those three tables,
    such as the page they came on; it is not kept), without it the last row of
    the table as it is read, which depends on how its files are split.  Returns ``(posts, rejects)``: posts whose
    author, place or media is missing go to ``rejects`` with a reason."""
    u = _last_rows(users, "id", "author_id", "user", order)
    p = _last_rows(places, "id", "__pid", "place", order)
    with_user = posts.join(u, "author_id", "left")
    base = with_user.withColumn("__pkey", F.col("geo.place_id")).join(p, F.col("__pkey") == F.col("__pid"), "left")
    has_keys = F.coalesce(F.size("attachments.media_keys") > 0, F.lit(False)) if "attachments" in posts.columns else F.lit(False)
    base = base.withColumn("__has_media", has_keys)
    if media is not None and "attachments" in posts.columns:
        m = _last_rows(media, "media_key", "media_key", "__m", order)
        keys = base.filter("__has_media").select(F.col("id").alias("__id"), F.explode("attachments.media_keys").alias("media_key")).distinct()
        joined = keys.join(m, "media_key", "left")
        per_post = joined.groupBy("__id").agg(
            F.map_from_entries(F.collect_list(F.when(F.col("__m").isNotNull(), F.struct("media_key", "__m")))).alias("media"),
            F.count_if(F.col("__m").isNull()).alias("__missing_media"),
        )
        base = base.join(per_post, F.col("id") == F.col("__id"), "left").drop("__id")
    else:
        base = base.withColumn("media", F.lit(None).cast(T.MapType(S, MEDIA))).withColumn("__missing_media", F.lit(0))
    reason = (
        F.when(F.col("user").isNull(), "missing user")
        .when(F.col("__pkey").isNotNull() & F.col("place").isNull(), "missing place")
        .when(F.coalesce(F.col("__missing_media"), F.lit(0)) > 0, "missing media")
    )
    base = base.withColumn("__reason", reason)
    out = base.filter(F.col("__reason").isNull())
    out = out.withColumn("geo", F.when(F.col("place").isNull(), F.col("geo")))
    if "attachments" in posts.columns:
        out = out.withColumn("attachments", F.when(~F.col("__has_media"), F.col("attachments")))
    helper = ["__pkey", "__pid", "__has_media", "__missing_media", "__reason", "author_id"]
    return out.drop(*helper), _rejects(posts, users, places, media)


def _rejects(posts: DataFrame, users: DataFrame, places: DataFrame, media: DataFrame | None) -> DataFrame:
    """``(id, reason)`` of the posts whose author, place or media is missing: only keys travel, no records."""

    def found(df: DataFrame, key: str, key_as: str, flag: str) -> DataFrame:
        return df.select(F.col(key).alias(key_as)).distinct().withColumn(flag, F.lit(True))

    base = posts.select("id", "author_id", F.col("geo.place_id").alias("__pkey"))
    base = base.join(found(users, "id", "author_id", "__user"), "author_id", "left")
    base = base.join(found(places, "id", "__pkey", "__place"), "__pkey", "left")
    reason = F.when(F.col("__user").isNull(), "missing user").when(F.col("__pkey").isNotNull() & F.col("__place").isNull(), "missing place")
    if media is not None and "attachments" in posts.columns:
        keys = posts.select("id", F.explode("attachments.media_keys").alias("media_key"))
        lost = keys.join(media.select("media_key"), "media_key", "left_anti")
        base = base.join(found(lost, "id", "id", "__lost"), "id", "left")
        reason = reason.when(F.col("__lost"), "missing media")
    return base.select("id", reason.alias("reason")).filter("reason is not null")


def attach_labels(posts: DataFrame, labels: DataFrame, id: str = "id") -> DataFrame:
    """Inner join of fetched posts with their labels; label columns win on
    name clashes (posts that could not be fetched disappear)."""
    clash = [c for c in labels.columns if c != id and c in posts.columns]
    return posts.drop(*clash).join(labels, id, "inner")


def flatten_user(df: DataFrame, user: str = "user") -> DataFrame:
    """``user_id``, ``user_username``, ``user_name`` from the user struct."""
    return df.withColumns(
        {
            "user_id": F.col(f"{user}.id"),
            "user_username": F.col(f"{user}.username"),
            "user_name": F.col(f"{user}.name"),
        }
    )
