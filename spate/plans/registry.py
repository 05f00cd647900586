"""Registry of queries over the driver tables, with an independent SQL oracle.

Each entry is ``name -> (spark_fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``.
The Spark side calls the library operators; the SQL side restates the same
semantics in DuckDB SQL so that the two can be compared row for row.  Every
query reads whole tables; none samples, caps or filters rows to be cheap.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spate.functions import text as tx
from spate.operators import clean, terms
from spate.plans import tables
from spate.session import cut_lineage, ensure_checkpoint_dir, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# ---------------------------------------------------------------------------
# Shared SQL fragments
# ---------------------------------------------------------------------------

CLEAN_DOCS_SQL = f"""
cleaned_src AS (
    SELECT doc_id AS id, lang, {tx.sql_clean_text('text')} AS text
    FROM documents
    WHERE NOT coalesce(starts_with(text, 'RT'), false)
),
cleaned AS (
    SELECT arg_min(id, id) AS id, arg_min(lang, id) AS lang, text
    FROM cleaned_src
    WHERE text IS NOT NULL AND text <> ''
    GROUP BY text
)"""


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = tables.documents_as_posts(spark, sf_dir).select("id", "text", "lang")
    # The raw texts are not asked for: they need not travel with the cleaned ones.
    cleaned = clean.clean_posts(posts, order="id", dedup=False).select("id", "lang", "text")
    return clean.dedup_text(cleaned, order="id")


def document_tokens(spark: SparkSession, sf_dir: str, reuse: bool = False) -> DataFrame:
    """Tokens of the cleaned documents.  ``reuse=True`` when a query reads the
    corpus in several branches (fit and apply, counts): the cleaned corpus is
    then written once below the checkpoint folder instead of being re-cleaned per
    branch."""
    toks = cleaned_documents(spark, sf_dir).select("id", "lang", tx.tokens("text").alias("tokens"))
    return stored(toks) if reuse else toks


# ---------------------------------------------------------------------------
# Step 1-2: cleaning and top weighted terms (the flagship)
# ---------------------------------------------------------------------------


@register(
    "clean_posts",
    f"""WITH {CLEAN_DOCS_SQL}
SELECT id, lang, text FROM cleaned""",
)
def q_clean_posts(spark, sf_dir):
    return cleaned_documents(spark, sf_dir)


TOKENS_SQL = f"""{CLEAN_DOCS_SQL},
toks AS (SELECT id, lang, unnest(string_split(text, ' ')) AS term FROM cleaned),
bow AS (SELECT id, term, count(*) AS n FROM toks GROUP BY id, term),
ndocs AS (SELECT count(*) AS n FROM cleaned),
idf AS (SELECT term, log2((SELECT n FROM ndocs) / count(*)) AS idf FROM bow GROUP BY term)"""


@register(
    "top_terms",
    f"""WITH {TOKENS_SQL},
sel AS (
    SELECT b.id, b.term, b.n * i.idf AS w
    FROM bow b JOIN idf i USING (term) JOIN cleaned d USING (id)
    WHERE d.lang = 'en' AND i.idf <> 0
),
norm AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM sel GROUP BY id),
wt AS (SELECT term, w / nrm AS weight FROM sel JOIN norm USING (id) WHERE abs(w / nrm) > 1e-12)
SELECT term, round(avg(weight), 5) AS mean, count(*) AS count FROM wt GROUP BY term""",
)
def q_top_terms(spark, sf_dir):
    docs = document_tokens(spark, sf_dir, reuse=True)
    selection = docs.filter(F.col("lang") == "en")
    return terms.top_terms(selection, all_docs=docs)


@register(
    "tfidf",
    f"""WITH {TOKENS_SQL},
w AS (SELECT b.id, b.term, b.n * i.idf AS w FROM bow b JOIN idf i USING (term) WHERE i.idf <> 0),
norm AS (SELECT id, sqrt(sum(w * w)) AS nrm FROM w GROUP BY id)
SELECT id, term, round(w / nrm, 5) AS weight FROM w JOIN norm USING (id) WHERE abs(w / nrm) > 1e-12""",
)
def q_tfidf(spark, sf_dir):
    docs = document_tokens(spark, sf_dir, reuse=True)
    return terms.tfidf(docs).select("id", "term", F.round("weight", 5).alias("weight"))


@register(
    "bag_of_words",
    f"""WITH {TOKENS_SQL}
SELECT id, term, n FROM bow""",
)
def q_bag_of_words(spark, sf_dir):
    return terms.bag_of_words(document_tokens(spark, sf_dir))


# ---------------------------------------------------------------------------
# Step 3: spam limiting, histograms, counts, selections (events as posts)
# ---------------------------------------------------------------------------

from spate.operators import dedup, views  # noqa: E402

EVENTS_POSTS_SQL = """posts AS (
    SELECT event_id AS id, ts AS created_at, user_id, event_type AS loc_name, value FROM events
)"""

# The selection used by the view queries: a predicate on the location column.
SELECTED_LOCATION = "click"


def _events(spark, sf_dir):
    return tables.events_as_posts(spark, sf_dir)


def _selected_ids(posts):
    return posts.filter(F.col("loc_name") == SELECTED_LOCATION).select("id")


@register(
    "one_per_user_week",
    f"""WITH {EVENTS_POSTS_SQL}
SELECT id, created_at, user_id, loc_name, value, CAST(date_trunc('week', created_at) AS DATE) + 6 AS week
FROM posts
WHERE user_id IS NOT NULL AND created_at IS NOT NULL AND loc_name IS NOT NULL
QUALIFY row_number() OVER (
    PARTITION BY user_id, date_trunc('week', created_at), loc_name ORDER BY created_at, id) = 1""",
)
def q_one_per_user_week(spark, sf_dir):
    return dedup.one_per_user_week(_events(spark, sf_dir), loc="loc_name")


@register(
    "one_per_user_week_any_location",
    f"""WITH {EVENTS_POSTS_SQL}
SELECT id, created_at, user_id, loc_name, value, CAST(date_trunc('week', created_at) AS DATE) + 6 AS week
FROM posts
WHERE user_id IS NOT NULL AND created_at IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('week', created_at) ORDER BY created_at, id) = 1""",
)
def q_one_per_user_week_any(spark, sf_dir):
    return dedup.one_per_user_week(_events(spark, sf_dir))


@register(
    "user_rollup",
    f"""WITH {EVENTS_POSTS_SQL}
SELECT user_id, first(id ORDER BY created_at, id) AS first_id, count(*) AS n_posts,
       min(created_at) AS first_time, max(created_at) AS last_time,
       count(DISTINCT loc_name) AS n_locations
FROM posts WHERE user_id IS NOT NULL GROUP BY user_id""",
)
def q_user_rollup(spark, sf_dir):
    return dedup.user_rollup(_events(spark, sf_dir))


@register(
    "merge_pages",
    """SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
)
def q_merge_pages(spark, sf_dir):
    conv = tables.table(spark, sf_dir, "conversations")
    return dedup.merge_pages(conv, id="conv_id", seq="turn")


@register(
    "value_counts",
    """SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type""",
)
def q_value_counts(spark, sf_dir):
    return views.value_counts(tables.table(spark, sf_dir, "events"), "event_type")


@register(
    "location_counts",
    f"""WITH {EVENTS_POSTS_SQL},
c AS (SELECT loc_name, count(*) AS n FROM posts WHERE loc_name IS NOT NULL GROUP BY loc_name),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, loc_name) AS rank FROM c)
SELECT loc_name, n, loc_name || ' (' || CAST(n AS VARCHAR) || ')' AS label, rank, rank <= 5 AS is_top FROM r""",
)
def q_location_counts(spark, sf_dir):
    return views.location_counts(_events(spark, sf_dir))


HISTOGRAM_SQL = f"""WITH {EVENTS_POSTS_SQL},
span AS (SELECT floor((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400000000) >= 30 AS monthly FROM posts),
b AS (
    SELECT CASE WHEN loc_name = '{SELECTED_LOCATION}' THEN 'selected' ELSE 'not_selected' END AS series,
           CASE WHEN (SELECT monthly FROM span) THEN last_day(CAST(created_at AS DATE)) ELSE CAST(created_at AS DATE) END AS bin
    FROM posts WHERE created_at IS NOT NULL
),
c AS (SELECT series, bin, count(*) AS n FROM b GROUP BY series, bin),
bounds AS (SELECT series, min(bin) AS lo, max(bin) AS hi FROM c GROUP BY series),
spine AS (
    SELECT series, CAST(d AS DATE) AS bin FROM bounds,
    LATERAL (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS d)
    WHERE NOT (SELECT monthly FROM span)
    UNION ALL
    SELECT series, last_day(CAST(d AS DATE)) AS bin FROM bounds,
    LATERAL (SELECT unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(date_trunc('month', hi) AS TIMESTAMP), INTERVAL 1 MONTH)) AS d)
    WHERE (SELECT monthly FROM span)
)
SELECT s.series, s.bin, coalesce(c.n, 0) AS n FROM spine s LEFT JOIN c USING (series, bin)"""


def _ids(posts="posts"):
    return F.array_join(F.transform(posts, lambda p: p["id"].cast("string")), ",").alias("ids")


@register(
    "user_posts",
    f"""WITH {EVENTS_POSTS_SQL},
r AS (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at NULLS FIRST, id) - 1 AS i
    FROM posts WHERE user_id IS NOT NULL
)
SELECT user_id, CAST(i // 20 AS BIGINT) AS page, count(*) AS n, min(created_at) AS from_time, max(created_at) AS to_time,
       string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids, string_agg(loc_name, ',' ORDER BY i) AS names
FROM r GROUP BY 1, 2""",
)
def q_user_posts(spark, sf_dir):
    pages = dedup.user_posts(_events(spark, sf_dir), size=20)
    times = F.transform("posts", lambda p: p["created_at"])
    return pages.select(
        "user_id", "page", "n", F.array_min(times).alias("from_time"), F.array_max(times).alias("to_time"),
        _ids(), F.array_join(F.transform("posts", lambda p: p["loc_name"]), ",").alias("names"),
    )


@register(
    "histogram_posts",
    HISTOGRAM_SQL[: HISTOGRAM_SQL.index("SELECT CASE")]
    + "SELECT id, "
    + HISTOGRAM_SQL[HISTOGRAM_SQL.index("SELECT CASE") + 7 : HISTOGRAM_SQL.index("c AS (")]
    + """r AS (SELECT *, row_number() OVER (PARTITION BY series, bin ORDER BY id) - 1 AS i FROM b)
SELECT series, bin, CAST(i // 1000 AS BIGINT) AS page, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids
FROM r GROUP BY 1, 2, 3""",
)
def q_histogram_posts(spark, sf_dir):
    posts = _events(spark, sf_dir)
    return views.histogram_posts(posts, _selected_ids(posts)).select("series", "bin", "page", "n", _ids())


@register("time_histogram", HISTOGRAM_SQL)
def q_time_histogram(spark, sf_dir):
    posts = _events(spark, sf_dir)
    return views.time_histogram(posts, _selected_ids(posts))


@register(
    "label_series",
    f"""WITH {EVENTS_POSTS_SQL},
s AS (
    SELECT CAST(date_trunc('week', created_at) AS DATE) + 6 AS bin,
           sum(CAST(loc_name = 'purchase' AS INTEGER)) AS purchase,
           sum(CAST(loc_name = 'error' AS INTEGER)) AS error
    FROM posts WHERE created_at IS NOT NULL GROUP BY 1
),
spine AS (SELECT CAST(unnest(generate_series(CAST(min(bin) AS TIMESTAMP), CAST(max(bin) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS bin FROM s)
SELECT spine.bin, CAST(coalesce(purchase, 0) AS BIGINT) AS purchase, CAST(coalesce(error, 0) AS BIGINT) AS error
FROM spine LEFT JOIN s USING (bin)""",
)
def q_label_series(spark, sf_dir):
    posts = _events(spark, sf_dir).select(
        "created_at",
        (F.col("loc_name") == "purchase").cast("int").alias("purchase"),
        (F.col("loc_name") == "error").cast("int").alias("error"),
    )
    return views.label_series(posts, ["purchase", "error"], freq="week")


@register(
    "summary",
    f"""WITH {EVENTS_POSTS_SQL},
sel AS (SELECT * FROM posts WHERE loc_name = '{SELECTED_LOCATION}')
SELECT (SELECT count(*) FROM posts) AS total,
       (SELECT count(*) FROM posts) AS with_location,
       count(*) AS selected, min(created_at) AS first_time, max(created_at) AS last_time,
       (SELECT count(DISTINCT loc_name) + coalesce(max(CAST(loc_name IS NULL AS INTEGER)), 0) FROM posts) AS total_locations,
       count(DISTINCT loc_name) AS selected_locations
FROM sel""",
)
def q_summary(spark, sf_dir):
    posts = _events(spark, sf_dir)
    sel = posts.filter(F.col("loc_name") == SELECTED_LOCATION)
    return views.summary(posts, posts, sel)


@register(
    "page",
    f"""WITH {EVENTS_POSTS_SQL}
SELECT id, created_at, user_id, loc_name, round(value, 3) AS value FROM posts
ORDER BY value DESC NULLS LAST, id LIMIT 20 OFFSET 40""",
)
def q_page(spark, sf_dir):
    return views.page(_events(spark, sf_dir), sort="value", desc=True, page_no=2, size=20)


@register(
    "split_selection",
    f"""WITH {EVENTS_POSTS_SQL}
SELECT * FROM posts WHERE id NOT IN (SELECT id FROM posts WHERE loc_name = '{SELECTED_LOCATION}')""",
)
def q_split_selection(spark, sf_dir):
    posts = _events(spark, sf_dir)
    return views.split_selection(posts, _selected_ids(posts))[1]


@register(
    "flag_selected",
    f"""WITH {EVENTS_POSTS_SQL}
SELECT id, created_at, user_id, loc_name, value, loc_name IS NOT DISTINCT FROM '{SELECTED_LOCATION}' AS selected FROM posts""",
)
def q_flag_selected(spark, sf_dir):
    posts = _events(spark, sf_dir)
    return views.flag_selected(posts, _selected_ids(posts))


@register(
    "intersect_ids",
    f"""WITH {EVENTS_POSTS_SQL}
SELECT DISTINCT id FROM posts WHERE loc_name IN ('click', 'view') AND value > 10 AND user_id < 100""",
)
def q_intersect_ids(spark, sf_dir):
    posts = _events(spark, sf_dir)
    return views.intersect_ids(
        posts.filter(F.col("loc_name").isin("click", "view")),
        posts.filter(F.col("value") > 10),
        posts.filter(F.col("user_id") < 100),
    )


@register(
    "slice_posts",
    f"""WITH {EVENTS_POSTS_SQL}
SELECT * FROM posts WHERE created_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'
AND loc_name = 'signup'""",
)
def q_slice_posts(spark, sf_dir):
    return views.slice_posts(
        _events(spark, sf_dir), "2024-01-03 00:00:00", "2024-01-10 12:00:00", loc_name="signup"
    )


LABELLED_DOCS_SQL = """labelled AS (
    SELECT d.doc_id AS id, d.text, d.lang, l.quality AS relevant, l.toxic AS mentions_impact
    FROM documents d JOIN labels l USING (doc_id)
)"""


def labelled_documents(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    lab = tables.table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), "text", "lang",
        F.col("quality").alias("relevant"), F.col("toxic").alias("mentions_impact"),
    )


@register(
    "union_labelled",
    f"""WITH {LABELLED_DOCS_SQL}
SELECT id, text, relevant AS label FROM labelled WHERE lang = 'en'
UNION ALL
SELECT id, text, relevant AS label FROM labelled WHERE lang <> 'en'""",
)
def q_union_labelled(spark, sf_dir):
    lab = labelled_documents(spark, sf_dir)
    return views.union_labelled(
        [lab.filter(F.col("lang") == "en"), lab.filter(F.col("lang") != "en")], "relevant"
    )


@register(
    "complete_labels",
    """SELECT * FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL
AND trim(CAST(quality AS VARCHAR)) <> '' AND trim(CAST(toxic AS VARCHAR)) <> ''""",
)
def q_complete_labels(spark, sf_dir):
    return views.complete_labels(tables.table(spark, sf_dir, "labels"), ["quality", "toxic"])


# ---------------------------------------------------------------------------
# Step 4: metrics, balancing, splits (labels ⋈ documents)
# ---------------------------------------------------------------------------

from spate.operators import classify  # noqa: E402

# A rule predictor used to exercise the metric operators against SQL: long
# documents are "predicted" relevant.
RULE_MIN_CHARS = 2000


@register(
    "binary_metrics",
    f"""WITH p AS (
    SELECT l.quality AS label, CAST(d.n_chars >= {RULE_MIN_CHARS} AS INTEGER) AS predicted_label
    FROM documents d JOIN labels l USING (doc_id)
), c AS (
    SELECT count_if(label = 1 AND predicted_label = 1) AS tp, count_if(label = 0 AND predicted_label = 0) AS tn,
           count_if(label = 0 AND predicted_label = 1) AS fp, count_if(label = 1 AND predicted_label = 0) AS fn FROM p
)
SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       (tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0) AS accuracy,
       tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS precision,
       tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS recall,
       tp / nullif(tp + 0.5 * (fp + fn), 0) AS f1
FROM c""",
)
def q_binary_metrics(spark, sf_dir):
    return classify.binary_metrics(_rule_predictions(spark, sf_dir))


def _rule_predictions(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    lab = tables.table(spark, sf_dir, "labels")
    return docs.join(lab, "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") >= RULE_MIN_CHARS).cast("int").alias("predicted_label")
    )


@register(
    "confusion",
    f"""WITH p AS (
    SELECT l.quality AS actual, CAST(d.n_chars >= {RULE_MIN_CHARS} AS INTEGER) AS predicted
    FROM documents d JOIN labels l USING (doc_id)
), g AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(actual, predicted))
SELECT g.actual, g.predicted, count(p.actual) AS n FROM g LEFT JOIN p USING (actual, predicted) GROUP BY g.actual, g.predicted""",
)
def q_confusion(spark, sf_dir):
    return classify.confusion(_rule_predictions(spark, sf_dir))


SEED = 7
KEY_SQL = f"md5('{SEED}:' || CAST(id AS VARCHAR))"


@register(
    "undersample",
    f"""WITH {LABELLED_DOCS_SQL},
r AS (SELECT id, text, relevant AS label, row_number() OVER (PARTITION BY relevant ORDER BY {KEY_SQL}, id) AS rk FROM labelled),
m AS (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM labelled GROUP BY relevant))
SELECT id, text, label FROM r WHERE rk <= (SELECT m FROM m)""",
)
def q_undersample(spark, sf_dir):
    lab = labelled_documents(spark, sf_dir).select("id", "text", F.col("relevant").alias("label"))
    return classify.undersample(lab, "label", seed=SEED)


@register(
    "split",
    f"""WITH {LABELLED_DOCS_SQL},
r AS (SELECT id, relevant AS label, row_number() OVER (ORDER BY {KEY_SQL}, id) AS rk FROM labelled),
n AS (SELECT count(*) AS n FROM labelled),
t AS (SELECT ceil(n * 0.1) AS held, ceil(ceil(n * 0.1) * 0.5) AS test FROM n)
SELECT id, label, CASE WHEN rk <= (SELECT test FROM t) THEN 'test' WHEN rk <= (SELECT held FROM t) THEN 'valid' ELSE 'train' END AS split
FROM r""",
)
def q_split(spark, sf_dir):
    lab = labelled_documents(spark, sf_dir).select("id", F.col("relevant").alias("label"))
    return classify.split(lab, seed=SEED)


# ---------------------------------------------------------------------------
# Step 5: places — toponyms, smallest location, clusters, regions
# ---------------------------------------------------------------------------

from spate.operators import geo  # noqa: E402
from spate.sources import gazetteer as gz  # noqa: E402
from spate.sources import regions as rg  # noqa: E402

_N_NAMES = len(gz.SAMPLE_MENTIONS)
_NAMES_SQL = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in gz.SAMPLE_MENTIONS) + "]"

# Every event mentions one to three place names chosen by integer arithmetic on
# its id, and sits at a coordinate derived the same way — identical in Spark
# and in SQL, and growing with the events table.
EVENT_TOPONYMS_SQL = f"""toponyms AS (
    SELECT event_id AS id, 0 AS pos, {_NAMES_SQL}[(event_id % {_N_NAMES}) + 1] AS word FROM events
    UNION ALL
    SELECT event_id, 1, {_NAMES_SQL}[((event_id * 7 + 3) % {_N_NAMES}) + 1] FROM events WHERE event_id % 3 <> 0
    UNION ALL
    SELECT event_id, 2, {_NAMES_SQL}[((event_id * 11 + 5) % {_N_NAMES}) + 1] FROM events WHERE event_id % 4 = 0
),
gaz AS (SELECT * FROM {gz.gazetteer_values_sql()}),
best AS (
    SELECT lower(name) AS key, place_id, display_name, boundingbox, lat, lon, importance, class, type FROM gaz
    WHERE upper(country_code) = 'SE'
    QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY importance DESC, place_id) = 1
),
resolved AS (SELECT t.id, t.pos, t.word, b.* EXCLUDE (key) FROM toponyms t LEFT JOIN best b ON lower(t.word) = b.key)"""


def event_toponyms(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events").select("event_id")
    names = F.array(*[F.lit(n) for n in gz.SAMPLE_MENTIONS])
    eid = F.col("event_id")

    def pick(expr):
        return F.element_at(names, (expr % _N_NAMES + 1).cast("int"))

    mentions = F.filter(
        F.array(
            F.struct(F.lit(0).alias("pos"), pick(eid).alias("word")),
            F.when(eid % 3 != 0, F.struct(F.lit(1).alias("pos"), pick(eid * 7 + 3).alias("word"))),
            F.when(eid % 4 == 0, F.struct(F.lit(2).alias("pos"), pick(eid * 11 + 5).alias("word"))),
        ),
        lambda m: m.isNotNull(),
    )
    return ev.select(eid.alias("id"), F.explode(mentions).alias("m")).select("id", "m.pos", "m.word")


def resolved_event_toponyms(spark, sf_dir):
    return geo.resolve_toponyms(event_toponyms(spark, sf_dir), gz.sample_gazetteer(spark), country="SE")


@register(
    "resolve_toponyms",
    f"""WITH {EVENT_TOPONYMS_SQL}
SELECT id, pos, word, CAST(place_id AS BIGINT) AS place_id, display_name FROM resolved""",
)
def q_resolve_toponyms(spark, sf_dir):
    r = resolved_event_toponyms(spark, sf_dir)
    return r.select("id", "pos", "word", F.col("loc.place_id").alias("place_id"), F.col("loc.display_name").alias("display_name"))


SMALLEST_SQL = f"""WITH {EVENT_TOPONYMS_SQL},
cand AS (
    SELECT *, abs(CAST(boundingbox[1] AS DOUBLE) - CAST(boundingbox[2] AS DOUBLE))
            + abs(CAST(boundingbox[3] AS DOUBLE) - CAST(boundingbox[4] AS DOUBLE)) AS size
    FROM resolved
    WHERE place_id IS NOT NULL
      AND NOT list_contains(list_transform(string_split(display_name, ','), lambda p: trim(p)), 'Lan')
      AND trim(string_split(display_name, ',')[1]) <> 'Sweden'
),
pick AS (
    SELECT * FROM cand WHERE size < 999
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY size, pos) = 1
)"""


@register(
    "smallest_location",
    f"""{SMALLEST_SQL}
SELECT id, CAST(place_id AS BIGINT) AS place_id, class, importance, type, display_name, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon,
       string_split(display_name, ',')[1] AS loc_name
FROM pick""",
)
def q_smallest_location(spark, sf_dir):
    best = geo.smallest_location(resolved_event_toponyms(spark, sf_dir))
    flat = geo.flatten_location(best.withColumn("place_id", F.col("loc.place_id")))
    return flat.drop("boundingbox")


@register(
    "country_mentions",
    f"""WITH {EVENT_TOPONYMS_SQL}
SELECT count(*) AS country_mentions FROM resolved
WHERE place_id IS NOT NULL
  AND NOT list_contains(list_transform(string_split(display_name, ','), lambda p: trim(p)), 'Lan')
  AND trim(string_split(display_name, ',')[1]) = 'Sweden'""",
)
def q_country_mentions(spark, sf_dir):
    return geo.country_mentions(resolved_event_toponyms(spark, sf_dir))


@register(
    "has_location",
    f"""WITH {EVENT_TOPONYMS_SQL}
SELECT id, bool_or(place_id IS NOT NULL) AS has_location FROM resolved GROUP BY id""",
)
def q_has_location(spark, sf_dir):
    return geo.has_location(resolved_event_toponyms(spark, sf_dir))


@register(
    "error_slices",
    f"""WITH {EVENT_TOPONYMS_SQL},
h AS (SELECT id, bool_or(place_id IS NOT NULL) AS has_location FROM resolved GROUP BY id),
a AS (SELECT h.id, h.has_location, CAST(e.value >= 25 AS INTEGER) AS mentions_location FROM h JOIN events e ON e.event_id = h.id)
SELECT id, has_location, mentions_location,
       CASE WHEN mentions_location = 1 AND has_location THEN 'blue' WHEN mentions_location = 0 AND has_location THEN 'red' END AS outcome,
       CASE WHEN mentions_location = 1 AND has_location THEN 'TP' WHEN mentions_location <> 1 AND NOT has_location THEN 'TN'
            WHEN mentions_location <> 1 AND has_location THEN 'FP' ELSE 'FN' END AS slice
FROM a""",
)
def q_error_slices(spark, sf_dir):
    h = geo.has_location(resolved_event_toponyms(spark, sf_dir))
    ev = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") >= 25).cast("int").alias("mentions_location"))
    return classify.error_slices(classify.outcome(h.join(ev, "id")))


@register(
    "error_details",
    f"""WITH {EVENT_TOPONYMS_SQL},
h AS (
    SELECT id, bool_or(place_id IS NOT NULL) AS has_location, count(word) AS n_toponyms,
           list_sort(list_distinct(coalesce(list(word) FILTER (WHERE place_id IS NOT NULL), []))) AS found
    FROM resolved GROUP BY id),
a AS (
    SELECT e.event_id AS id, CAST(e.value >= 25 AS INTEGER) AS mentions_location, coalesce(h.has_location, false) AS has_location,
           coalesce(h.n_toponyms, 0) AS n_toponyms, coalesce(h.found, []) AS found
    FROM events e LEFT JOIN h ON e.event_id = h.id)
SELECT id, has_location, mentions_location, n_toponyms,
       CASE WHEN mentions_location = 1 AND has_location THEN 'TP' WHEN mentions_location <> 1 AND NOT has_location THEN 'TN'
            WHEN mentions_location <> 1 AND has_location THEN 'FP' WHEN n_toponyms > 0 THEN 'FN with toponyms' ELSE 'FN without toponyms' END AS detail,
       array_to_string(CASE WHEN mentions_location <> 1 AND has_location THEN found ELSE [] END, ',') AS names
FROM a""",
)
def q_error_details(spark, sf_dir):
    resolved = cut_lineage(resolved_event_toponyms(spark, sf_dir))
    ev = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") >= 25).cast("int").alias("mentions_location"))
    posts = ev.join(geo.has_location(resolved), "id", "left").withColumn("has_location", F.coalesce("has_location", F.lit(False)))
    out = classify.error_details(classify.error_slices(posts), resolved)
    return out.select("id", "has_location", "mentions_location", "n_toponyms", "detail", F.array_join("names", ",").alias("names"))


def _key_sql(x: str) -> str:
    return f"lower(translate({x}, {tx._sql_str(tx.PUNCTUATION)}, ''))"


def _split_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {tx._sql_str(tx.WHITESPACE_CLASS + '+')}), lambda w: w <> '')"


_NO_NOISE_SQL = f"regexp_replace(text, {tx._sql_str(tx.noise_pattern(numbers=False))}, ' ', 'g')"
_NAME_SQL = _split_sql(_key_sql(f"array_to_string(list_slice({_split_sql('text')}, 1, 2 + doc_id % 3), ' ')"))


@register(
    "extract_toponyms",
    f"""WITH RECURSIVE src AS (
    SELECT doc_id AS id, {_split_sql(_NO_NOISE_SQL)} AS w
    FROM documents WHERE text IS NOT NULL),
keyed AS (SELECT id, w, list_transform(w, lambda x: {_key_sql("x")}) AS k FROM src),
names AS (SELECT DISTINCT {_NAME_SQL} AS name FROM documents WHERE text IS NOT NULL),
shape AS (SELECT array_to_string(name, ' ') AS name, len(name) AS n FROM names WHERE len(name) > 0),
word AS (SELECT id, unnest(range(len(w))) AS pos, unnest(w) AS w, unnest(k) AS k FROM keyed),
ahead AS (
    SELECT id, pos, w AS w1, k AS k1, lead(w, 1) OVER o AS w2, lead(k, 1) OVER o AS k2, lead(w, 2) OVER o AS w3, lead(k, 2) OVER o AS k3,
           lead(w, 3) OVER o AS w4, lead(k, 3) OVER o AS k4
    FROM word WINDOW o AS (PARTITION BY id ORDER BY pos)),
phrase AS (
    SELECT id, pos, 1 AS n, k1 AS name, w1 AS word FROM ahead
    UNION ALL SELECT id, pos, 2, k1 || ' ' || k2, w1 || ' ' || w2 FROM ahead
    UNION ALL SELECT id, pos, 3, k1 || ' ' || k2 || ' ' || k3, w1 || ' ' || w2 || ' ' || w3 FROM ahead
    UNION ALL SELECT id, pos, 4, k1 || ' ' || k2 || ' ' || k3 || ' ' || k4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead),
hit AS (SELECT id, pos, max(n) AS n, arg_max(word, n) AS word FROM phrase JOIN shape USING (n, name) GROUP BY id, pos),
chain AS (
    SELECT id, pos, CASE WHEN a >= pos + n THEN a WHEN b >= pos + n THEN b WHEN c >= pos + n THEN c ELSE d END AS next
    FROM (SELECT id, pos, n, lead(pos, 1) OVER o AS a, lead(pos, 2) OVER o AS b, lead(pos, 3) OVER o AS c, lead(pos, 4) OVER o AS d
          FROM hit WINDOW o AS (PARTITION BY id ORDER BY pos))),
taken AS (
    SELECT id, min(pos) AS pos FROM hit GROUP BY id
    UNION ALL
    SELECT c.id, c.next FROM taken t JOIN chain c USING (id, pos) WHERE c.next IS NOT NULL)
SELECT id, word, min(pos) AS pos FROM taken JOIN hit USING (id, pos) GROUP BY id, word""",
)
def q_extract_toponyms(spark, sf_dir):
    """J3 over whole texts.  The stand-in gazetteer has one name a document: its first two to four words."""
    docs = tables.documents_as_posts(spark, sf_dir).select("id", "text")
    name = F.array_join(F.slice(tx.split_words("text"), F.lit(1), (F.col("id") % 3 + 2).cast("int")), " ")
    places = docs.filter("text is not null").select(
        name.alias("name"), F.lit("SE").alias("country_code"), F.col("id").alias("place_id"), F.lit(0.5).alias("importance")
    )
    return geo.extract_toponyms(docs, places)


POINTS_SQL = """points AS (
    SELECT event_id AS id, event_type AS loc_name,
           11 + ((event_id * 7) % 1300) / 100.0 AS lon, 55 + ((event_id * 13) % 1400) / 100.0 AS lat
    FROM events
)"""


def event_points(spark, sf_dir):
    ev = tables.table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("loc_name"),
        (F.lit(11) + (F.col("event_id") * 7 % 1300) / F.lit(100.0)).alias("lon"),
        (F.lit(55) + (F.col("event_id") * 13 % 1400) / F.lit(100.0)).alias("lat"),
    )


@register(
    "coordinate_rollup",
    f"""WITH {POINTS_SQL}
SELECT lon, lat, count(*) AS n, min(id) AS first_id, arg_min(loc_name, id) AS loc_name FROM points GROUP BY lon, lat""",
)
def q_coordinate_rollup(spark, sf_dir):
    return geo.coordinate_rollup(event_points(spark, sf_dir))


CLUSTER_ZOOM = 5


@register(
    "grid_clusters",
    f"""WITH {POINTS_SQL},
px AS (
    SELECT id, lon, lat,
           floor((lon + 180.0) / 360.0 * {256 * 2 ** CLUSTER_ZOOM}.0 / 50) AS cx,
           floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * {256 * 2 ** CLUSTER_ZOOM}.0 / 50) AS cy
    FROM points
)
SELECT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy, count(*) AS n,
       sum(CAST(round(lon * 1e6) AS BIGINT)) / count(*) / 1e6 AS lon,
       sum(CAST(round(lat * 1e6) AS BIGINT)) / count(*) / 1e6 AS lat,
       min(id) AS first_id
FROM px GROUP BY cx, cy""",
)
def q_grid_clusters(spark, sf_dir):
    # Means come from exact integer sums, so they compare unrounded.
    return geo.grid_clusters(event_points(spark, sf_dir), zoom=CLUSTER_ZOOM)


@register(
    "cluster_posts",
    f"""WITH {POINTS_SQL},
px AS (
    SELECT id, CAST(floor((lon + 180.0) / 360.0 * {256 * 2 ** CLUSTER_ZOOM}.0 / 50) AS BIGINT) AS cx,
           CAST(floor((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * {256 * 2 ** CLUSTER_ZOOM}.0 / 50) AS BIGINT) AS cy
    FROM points
),
r AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY id) - 1 AS i FROM px)
SELECT cx, cy, CAST(i // 1000 AS BIGINT) AS page, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) AS ids
FROM r GROUP BY 1, 2, 3""",
)
def q_cluster_posts(spark, sf_dir):
    return geo.cluster_posts(event_points(spark, sf_dir), zoom=CLUSTER_ZOOM).select("cx", "cy", "page", "n", _ids())


@register(
    "nearest",
    f"""WITH {POINTS_SQL}
SELECT id, loc_name, lon, lat, (lon - 15.0) * (lon - 15.0) + (lat - 60.0) * (lat - 60.0) AS distance
FROM points ORDER BY distance, id LIMIT 25""",
)
def q_nearest(spark, sf_dir):
    return views.nearest(event_points(spark, sf_dir), 15.0, 60.0, 25)


@register(
    "at_point",
    f"""WITH {POINTS_SQL}
SELECT * FROM points WHERE lon = 18.0 AND lat = 60.0""",
)
def q_at_point(spark, sf_dir):
    return views.at_point(event_points(spark, sf_dir), 18.0, 60.0)


PIP_SQL = f"""WITH {POINTS_SQL},
regions AS (SELECT * FROM {rg.regions_values_sql()}),
tested AS (
    SELECT p.*, r.level AS region_level, r.name AS region_name,
        list_sum(list_transform(r.rings, lambda ring: list_sum(list_transform(range(1, len(ring)), lambda i:
            CASE WHEN (ring[i].y > p.lat) <> (ring[i + 1].y > p.lat) THEN
                CASE WHEN p.lon < (ring[i + 1].x - ring[i].x) * (p.lat - ring[i].y) / (ring[i + 1].y - ring[i].y) + ring[i].x THEN 1 ELSE 0 END
            ELSE 0 END)))) AS crossings,
        list_bool_or(list_transform(r.rings, lambda ring: list_bool_or(list_transform(range(1, len(ring)), lambda i:
            (ring[i + 1].x - ring[i].x) * (p.lat - ring[i].y) - (ring[i + 1].y - ring[i].y) * (p.lon - ring[i].x) = 0
            AND p.lon BETWEEN least(ring[i].x, ring[i + 1].x) AND greatest(ring[i].x, ring[i + 1].x)
            AND p.lat BETWEEN least(ring[i].y, ring[i + 1].y) AND greatest(ring[i].y, ring[i + 1].y))))) AS on_edge
    FROM points p CROSS JOIN regions r
)"""


@register(
    "points_in_regions",
    f"""{PIP_SQL}
SELECT DISTINCT id, loc_name, lon, lat, region_level, region_name FROM tested WHERE on_edge OR crossings % 2 = 1""",
)
def q_points_in_regions(spark, sf_dir):
    return geo.points_in_regions(event_points(spark, sf_dir), rg.sample_regions(spark))


@register(
    "filter_region",
    f"""{PIP_SQL}
SELECT DISTINCT id, loc_name, lon, lat FROM tested WHERE region_name = 'North' AND (on_edge OR crossings % 2 = 1)""",
)
def q_filter_region(spark, sf_dir):
    return geo.filter_region(event_points(spark, sf_dir), rg.sample_regions(spark), "North")


# ---------------------------------------------------------------------------
# Step 6: near duplicates, vocabulary, phrases
# ---------------------------------------------------------------------------

from spate.operators import lsh, similarity  # noqa: E402


def _near_dup_sql(thr: float) -> str:
    return f"""WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT j.vec_id, j.label FROM e j
WHERE NOT EXISTS (
    SELECT 1 FROM e i
    WHERE i.vec_id < j.vec_id
      AND list_dot_product(i.v, j.v) / (sqrt(list_dot_product(i.v, i.v)) * sqrt(list_dot_product(j.v, j.v))) > {thr}
)"""


def _near_dup(spark, sf_dir, thr):
    emb = tables.table(spark, sf_dir, "embeddings")
    kept = similarity.drop_near_duplicates(emb, vec="embedding", order="vec_id", id="vec_id", thr=thr)
    return kept.select("vec_id", "label")


@register("drop_near_duplicates", _near_dup_sql(0.8))
def q_drop_near_duplicates(spark, sf_dir):
    return _near_dup(spark, sf_dir, 0.8)


@register("drop_near_duplicates_thr04", _near_dup_sql(0.4))
def q_drop_near_duplicates_04(spark, sf_dir):
    return _near_dup(spark, sf_dir, 0.4)


@register("drop_near_duplicates_lsh")
def q_drop_near_duplicates_lsh(spark, sf_dir):
    """J8, candidate mode: every row kept has no similar earlier row among its candidates."""
    emb = tables.table(spark, sf_dir, "embeddings")
    kept = lsh.drop_near_duplicates_lsh(emb, vec="embedding", order="vec_id", id="vec_id", thr=0.8)
    return kept.select("vec_id", "label")


@register("similar_rows_recall")
def q_similar_rows_recall(spark, sf_dir):
    """Recall of the candidate mode: every hundredth id against all rows, found and by brute force, per threshold."""
    emb = tables.table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    asked = emb.filter("id % 100 = 0")
    out = None
    for thr in (0.4, 0.8):
        found = lsh.similar_rows_lsh(asked, emb, thr=thr).groupBy().agg(F.count(F.lit(1)).alias("n_found"))
        true = similarity.similar_rows(asked, emb, thr=thr).groupBy().agg(F.count(F.lit(1)).alias("n_true"))
        row = true.withColumn("n_found", found.scalar()).withColumn("threshold", F.lit(thr))
        out = row if out is None else out.unionByName(row)
    return out.select("threshold", "n_true", "n_found", F.try_divide("n_found", "n_true").alias("recall"))


@register(
    "vocabulary",
    f"""WITH {TOKENS_SQL}
SELECT term, count(*) AS df FROM bow GROUP BY term
HAVING count(*) >= least(20, 0.05 * (SELECT n FROM ndocs)) AND count(*) <= 0.75 * (SELECT n FROM ndocs)""",
)
def q_vocabulary(spark, sf_dir):
    return terms.vocabulary(document_tokens(spark, sf_dir, reuse=True))


@register(
    "tfidf_smooth",
    f"""WITH t AS (
    SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '{terms.SMOOTH_TOKEN_PATTERN}')) AS term FROM documents
),
bow AS (SELECT id, term, count(*) AS n FROM t GROUP BY id, term),
nd AS (SELECT count(*) AS n FROM documents),
idf AS (SELECT term, ln((1 + (SELECT n FROM nd)) / (1 + count(*))) + 1 AS idf FROM bow GROUP BY term),
w AS (SELECT id, term, n * idf AS w FROM bow JOIN idf USING (term)),
nrm AS (SELECT id, sqrt(sum(w * w)) AS s FROM w GROUP BY id)
SELECT id, term, round(w / s, 5) AS weight FROM w JOIN nrm USING (id)""",
)
def q_tfidf_smooth(spark, sf_dir):
    docs = tables.spread(tables.table(spark, sf_dir, "documents"))
    w = terms.tfidf_smooth(docs, id="doc_id", text="text")
    return w.select("id", "term", F.round("weight", 5).alias("weight"))


@register(
    "hashtags",
    """SELECT doc_id AS id,
       array_to_string(list_filter(regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+'),
                       lambda w: w <> '' AND starts_with(w, '#')), ', ') AS hashtags
FROM documents""",
)
def q_hashtags(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), tx.hashtags("text").alias("hashtags"))


from spate.operators import phrases  # noqa: E402

TOKEN_LISTS_SQL = f"""{CLEAN_DOCS_SQL},
tl AS (SELECT id, string_split(text, ' ') AS t FROM cleaned),
uni AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM tl) GROUP BY w),
pairs AS (
    SELECT id, pos, t[pos + 1] AS a, t[pos + 2] AS b
    FROM (SELECT id, t, unnest(range(0, len(t) - 1)) AS pos FROM tl)
),
pc AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b),
ph AS (
    SELECT a, b, pc.n,
           (pc.n - {phrases.BIGRAM_MIN_COUNT}) / ua.c / ub.c * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM pc)) AS score
    FROM pc JOIN uni ua ON ua.w = pc.a JOIN uni ub ON ub.w = pc.b
),
phr AS (SELECT * FROM ph WHERE score > {phrases.BIGRAM_THRESHOLD})"""


@register(
    "bigram_phrases",
    f"""WITH {TOKEN_LISTS_SQL}
SELECT a, b, n, score FROM phr""",
)
def q_bigram_phrases(spark, sf_dir):
    # The score is the same sequence of IEEE operations in both engines, so it
    # is compared unrounded (rounding would only add tie-breaking differences).
    ph = phrases.bigram_phrases(document_tokens(spark, sf_dir, reuse=True))
    return ph.select("a", "b", "n", "score")


@register(
    "bigram_tokens",
    f"""WITH {TOKEN_LISTS_SQL},
hits AS (SELECT p.id, p.pos, p.a, p.b FROM pairs p SEMI JOIN phr USING (a, b)),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM hits),
offs AS (SELECT *, pos - min(pos) OVER (PARTITION BY id, run) AS off FROM runs)
SELECT id, pos, a || '_' || b AS token FROM offs WHERE off % 2 = 0""",
)
def q_bigram_tokens(spark, sf_dir):
    docs = document_tokens(spark, sf_dir, reuse=True)
    return phrases.bigram_positions(docs, phrases.bigram_phrases(docs))


@register(
    "ngram_vocabulary",
    f"""WITH {CLEAN_DOCS_SQL},
tl AS (SELECT id, string_split(text, ' ') AS t FROM cleaned),
g AS (SELECT array_to_string(t[i:i + 4], ' ') AS ngram FROM (SELECT t, unnest(range(1, len(t) - 3)) AS i FROM tl))
SELECT ngram, count(*) AS count FROM g GROUP BY ngram""",
)
def q_ngram_vocabulary(spark, sf_dir):
    return phrases.ngram_vocabulary(document_tokens(spark, sf_dir), n=5)


def _lemma_map_sql() -> str:
    table = dict(phrases.SAMPLE_LEMMAS)
    table.update(phrases.FORCED_LEMMAS)
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(table.items())) + "}"


def _prepare_docs_sql() -> str:
    stop = tx.default_stop_words("english")
    first = tx.sql_clean_text("text", stop_words=stop)
    second = tx.sql_clean_text("j", stop_words=stop, extra_words=tx.TOPIC_EXTRA_WORDS)
    lem = _lemma_map_sql()
    return f"""WITH {CLEAN_DOCS_SQL},
p1 AS (SELECT id, {first} AS t1 FROM cleaned),
p2 AS (
    SELECT id, array_to_string(list_filter(list_transform(list_filter(string_split(t1, ' '), lambda w: w <> ''),
                                                          lambda w: coalesce({lem}[w], w)),
                                           lambda w: length(w) > 1), ' ') AS j
    FROM p1
),
p3 AS (SELECT id, list_filter(string_split({second}, ' '), lambda w: w <> '') AS t FROM p2),
uni AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM p3) GROUP BY w),
pairs AS (SELECT id, pos, t[pos + 1] AS a, t[pos + 2] AS b FROM (SELECT id, t, unnest(range(0, len(t) - 1)) AS pos FROM p3)),
pc AS (SELECT a, b, count(*) AS n FROM pairs GROUP BY a, b),
phr AS (
    SELECT a, b FROM pc JOIN uni ua ON ua.w = pc.a JOIN uni ub ON ub.w = pc.b
    WHERE (pc.n - {phrases.BIGRAM_MIN_COUNT}) / ua.c / ub.c * ((SELECT count(*) FROM uni) + (SELECT count(*) FROM pc)) > {phrases.BIGRAM_THRESHOLD}
),
hits AS (SELECT p.id, p.pos, p.a, p.b FROM pairs p SEMI JOIN phr USING (a, b)),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS run FROM hits),
offs AS (SELECT *, pos - min(pos) OVER (PARTITION BY id, run) AS off FROM runs),
bg AS (SELECT id, list(a || '_' || b ORDER BY pos) AS bt FROM offs WHERE off % 2 = 0 GROUP BY id)
SELECT id, len(t) + coalesce(len(bt), 0) AS n_tokens, array_to_string(list_concat(t, coalesce(bt, [])), ' ') AS doc
FROM p3 LEFT JOIN bg USING (id)"""


@register("prepare_docs", _prepare_docs_sql())
def q_prepare_docs(spark, sf_dir):
    posts = cleaned_documents(spark, sf_dir).withColumn("text_raw", F.col("text"))
    docs = phrases.prepare_docs(stored(posts), language="english")
    return docs.select("id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("doc"))


def _rake_sql() -> str:
    stop = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(tx.default_stop_words("english")))) + "]"
    ws = tx.WHITESPACE_CLASS + "+"
    breaks = phrases.RAKE_BREAKS.replace("'", "''")
    return f"""WITH src AS (
    SELECT doc_id AS id, regexp_replace(translate(lower(text), '{breaks}', '{"|" * len(phrases.RAKE_BREAKS)}'), '\\|', ' | ', 'g') AS m FROM documents
),
w AS (
    SELECT id, list_transform(
        list_filter(regexp_split_to_array(regexp_replace(m, '[^\\p{{L}}\\p{{N}}|'' ]', ' ', 'g'), '{ws}'), lambda x: x <> ''),
        lambda x: CASE WHEN list_contains({stop}, x) THEN '|' ELSE x END) AS ws
    FROM src
),
chunks AS (SELECT id, unnest(string_split(array_to_string(ws, ' '), '|')) AS chunk FROM w),
ph AS (
    SELECT row_number() OVER () AS pid, p AS phrase FROM (
        SELECT list_filter(regexp_split_to_array(chunk, '{ws}'), lambda x: x <> '') AS p FROM chunks
    ) WHERE len(p) > 0
),
words AS (SELECT pid, len(phrase) AS l, unnest(phrase) AS w FROM ph),
ws AS (SELECT w, CAST(round(sum(l) * 1e6 / count(*)) AS BIGINT) AS s FROM words GROUP BY w),
scored AS (SELECT pid, sum(s) / 1e6 AS score FROM words JOIN ws USING (w) GROUP BY pid),
d AS (SELECT DISTINCT array_to_string(phrase, ' ') AS phrase, score FROM ph JOIN scored USING (pid))
SELECT phrase, round(score, 6) AS score FROM d ORDER BY score DESC, phrase LIMIT 10"""


@register("rake", _rake_sql())
def q_rake(spark, sf_dir):
    top = phrases.rake(tables.documents_as_posts(spark, sf_dir), n=10)
    return top.select("phrase", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------------------
# Step 7: models — classifier, topics, clustering, layout (rows-only checks)
# ---------------------------------------------------------------------------

from spate.operators import cluster, topic_model, topics  # noqa: E402


@register("dbscan")
def q_dbscan(spark, sf_dir):
    docs = cut_lineage(cleaned_documents(spark, sf_dir))
    w = terms.tfidf_smooth(docs, id="id", text="text")
    return cluster.dbscan(w, docs.select("id"), eps=1.2, min_samples=2)


@register("kmeans")
def q_kmeans(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    emb = tables.table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector("embedding").alias("features"))
    _, out = cluster.kmeans(emb, k=5, seed=1)
    return out.select("vec_id", "label", "cluster")


@register("project_2d")
def q_project_2d(spark, sf_dir):
    docs = stored(cleaned_documents(spark, sf_dir))
    w = terms.tfidf_smooth(docs, id="id", text="text", in_blocks=True)
    return cluster.project_2d(w, docs.select("id"))


LDA_TOPICS = 2


@register("topic_terms")
def q_topic_terms(spark, sf_dir):
    model, entries = topic_model.fit_documents(document_tokens(spark, sf_dir, reuse=True), k=LDA_TOPICS, seed=1)
    return topic_model.topic_terms(topic_model.term_topic_weights(model, entries), LDA_TOPICS)


@register("lsi")
def q_lsi(spark, sf_dir):
    return topics.lsi(terms.tfidf(document_tokens(spark, sf_dir, reuse=True), in_blocks=True), k=2)


def _labelled_tokens(spark, sf_dir):
    lab = labelled_documents(spark, sf_dir)
    clean_lab = clean.clean_posts(lab, order="id", dedup=False)
    return clean_lab.select("id", "relevant", "mentions_impact", tx.tokens("text").alias("tokens"))


@register("classifier_metrics")
def q_classifier_metrics(spark, sf_dir):
    data = classify.split(_labelled_tokens(spark, sf_dir).withColumnRenamed("relevant", "label"), seed=SEED)
    model = classify.train(data.filter(F.col("split") == "train"), label="label")
    scored = classify.predict(data.filter(F.col("split") != "train"), model)
    return classify.binary_metrics(scored)


@register("predict_relevance")
def q_predict_relevance(spark, sf_dir):
    data = cut_lineage(_labelled_tokens(spark, sf_dir).withColumnRenamed("relevant", "label"))
    model = classify.train(data, label="label")
    scored = classify.predict(data, model)
    return classify.with_loss(scored).select("id", "label", "softmax", "predicted_label", "loss")


@register("predict_user_model")
def q_predict_user_model(spark, sf_dir):
    """M18 with a model of the user's own: here the fitted pipeline as a numpy function, sent once as a broadcast of
    2^18 weights (2 MB whatever the data)."""
    data = cut_lineage(_labelled_tokens(spark, sf_dir).withColumnRenamed("relevant", "label"))
    stored = spark.sparkContext.broadcast(classify.HashedLinear.of(classify.train(data, label="label")))
    scored = classify.predict_with(data, lambda: stored.value, ["tokens"])
    return classify.with_loss(scored).select("id", "label", "softmax", "predicted_label", "loss")


@register("hardest_positives")
def q_hardest_positives(spark, sf_dir):
    data = cut_lineage(_labelled_tokens(spark, sf_dir).withColumnRenamed("relevant", "label"))
    scored = classify.with_loss(classify.predict(data, classify.train(data, label="label")))
    return views.hardest(scored, score="loss", n=100).select("id", "label", "loss")


# ---------------------------------------------------------------------------
# Step 8-9: sources/joins on driver tables, streaming twins
# ---------------------------------------------------------------------------

from spate.sources import posts as src  # noqa: E402

# orders as posts, customer as users, nation as places.  The place id of an
# order is derived from its key: every 7th order has no place (geo kept), and
# ids 25 and 26 name no nation (such posts are rejected).
PLACE_ID_SQL = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 27 AS INTEGER) END"

ASSEMBLE_SQL = f"""WITH p AS (
    SELECT o_orderkey AS id, o_orderpriority AS text, o_custkey AS author_id, {PLACE_ID_SQL} AS place_id FROM orders
)
SELECT p.id, p.text, c.c_custkey AS user_id, c.c_name AS user_username, c.c_mktsegment AS user_name,
       n.n_name AS place_name, CAST(NULL AS INTEGER) AS geo_place_id
FROM p JOIN customer c ON c.c_custkey = p.author_id
LEFT JOIN nation n ON n.n_nationkey = p.place_id
WHERE p.place_id IS NULL OR n.n_nationkey IS NOT NULL"""


def _search_page(spark, sf_dir):
    orders = tables.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.col("o_custkey").alias("author_id"),
        F.struct(
            F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 27).cast("int")).alias("place_id")
        ).alias("geo"),
    )
    users = tables.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.col("c_mktsegment").alias("name")
    )
    places = tables.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    return orders, users, places


def _assembled(spark, sf_dir):
    return src.assemble_posts(*_search_page(spark, sf_dir))


@register("assemble_posts", ASSEMBLE_SQL)
def q_assemble_posts(spark, sf_dir):
    out, _ = _assembled(spark, sf_dir)
    return src.flatten_user(out).select(
        "id", "text", "user_id", "user_username", "user_name",
        F.col("place.name").alias("place_name"), F.col("geo.place_id").alias("geo_place_id"),
    )


# The parts of an order are the media keys of a post; parts of size 50 have no record (such posts are rejected).
MEDIA_SQL = f"""WITH p AS (
    SELECT o_orderkey AS id, o_custkey AS author_id, {PLACE_ID_SQL} AS place_id FROM orders
), k AS (
    SELECT DISTINCT l_orderkey AS id, CAST(l_partkey AS VARCHAR) AS media_key FROM lineitem
), m AS (
    SELECT CAST(p_partkey AS VARCHAR) AS media_key, p_type FROM part WHERE p_size < 50
), j AS (
    SELECT k.id, COUNT(*) AS n_media, COUNT(*) FILTER (WHERE m.media_key IS NULL) AS missing,
           STRING_AGG(k.media_key || ':' || m.p_type, ',' ORDER BY k.media_key || ':' || m.p_type) AS media
    FROM k LEFT JOIN m ON m.media_key = k.media_key GROUP BY k.id
), r AS (
    SELECT p.id, n.n_name AS place_name, COALESCE(j.n_media, 0) AS n_media, COALESCE(j.media, '') AS media,
           CASE WHEN c.c_custkey IS NULL THEN 'missing user'
                WHEN p.place_id IS NOT NULL AND n.n_nationkey IS NULL THEN 'missing place'
                WHEN j.missing > 0 THEN 'missing media' END AS reason
    FROM p LEFT JOIN customer c ON c.c_custkey = p.author_id LEFT JOIN nation n ON n.n_nationkey = p.place_id
    LEFT JOIN j ON j.id = p.id
)"""


LINES_PER_TASK = 1_000_000


def _assembled_media(spark, sf_dir):
    posts, users, places = _search_page(spark, sf_dir)
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("okey"), F.col("l_partkey").cast("string").alias("key"))
    # The sets of keys are sorted in a task: partitions of a bounded number of lines.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_PER_TASK))
    keys = lines.repartition(parts, "okey").groupBy("okey").agg(F.struct(F.collect_set("key").alias("media_keys")).alias("attachments"))
    posts = posts.join(keys, posts["id"] == keys["okey"], "left").drop("okey")
    media = tables.table(spark, sf_dir, "part").filter("p_size < 50").select(
        F.col("p_partkey").cast("string").alias("media_key"), F.col("p_type").alias("type"), F.col("p_brand").alias("url")
    )
    return src.assemble_posts(posts, users, places, media)


@register("assemble_media", MEDIA_SQL + " SELECT id, place_name, n_media, media, FALSE AS has_attachments FROM r WHERE reason IS NULL")
def q_assemble_media(spark, sf_dir):
    out, _ = _assembled_media(spark, sf_dir)
    each = F.transform(F.map_values("media"), lambda m: F.concat_ws(":", m["media_key"], m["type"]))
    return out.select(
        "id", F.col("place.name").alias("place_name"), F.coalesce(F.size("media"), F.lit(0)).cast("long").alias("n_media"),
        F.coalesce(F.array_join(F.array_sort(each), ","), F.lit("")).alias("media"), F.col("attachments").isNotNull().alias("has_attachments"),
    )


@register("assemble_media_rejects", MEDIA_SQL + " SELECT id, reason FROM r WHERE reason IS NOT NULL")
def q_assemble_media_rejects(spark, sf_dir):
    return _assembled_media(spark, sf_dir)[1]


@register(
    "assemble_rejects",
    f"""WITH p AS (SELECT o_orderkey AS id, o_custkey, {PLACE_ID_SQL} AS place_id FROM orders)
SELECT id, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer) THEN 'missing user' ELSE 'missing place' END AS reason
FROM p WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
   OR (place_id IS NOT NULL AND place_id NOT IN (SELECT n_nationkey FROM nation))""",
)
def q_assemble_rejects(spark, sf_dir):
    return _assembled(spark, sf_dir)[1]


@register(
    "attach_labels",
    """SELECT d.doc_id AS id, d.text, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)""",
)
def q_attach_labels(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    lab = tables.table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return src.attach_labels(docs, lab)


from spate.streaming import posts as stream  # noqa: E402

EVENTS_STREAM_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _event_stream(spark, sf_dir):
    from pyspark.sql.types import _parse_datatype_string

    return stream.read_stream_table(spark, sf_dir, "events.parquet", _parse_datatype_string(EVENTS_STREAM_SCHEMA))


STREAM_BATCHES = 5


def _stream_name(prefix, sf_dir):
    import uuid

    return f"{prefix}-{uuid.uuid4().hex}"


@register(
    "stream_daily_counts",
    """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_start, CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY AS day_end,
       count(*) AS n FROM events GROUP BY 1, 2
HAVING CAST(date_trunc('day', ts) AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
)
def q_stream_daily_counts(spark, sf_dir):
    s = stream.daily_counts_stream(_event_stream(spark, sf_dir), ts="ts", delay="1 hour")
    # Append mode emits a day once the watermark (latest event time − 1 hour)
    # has passed its end: the still-open last day is not emitted yet.
    out = stream.run_to_table(spark, s, _stream_name("daily", sf_dir), mode="append")
    return out.select(
        F.col("day_start").cast("timestamp_ntz").alias("day_start"), F.col("day_end").cast("timestamp_ntz").alias("day_end"), "n"
    )


@register(
    "stream_dedup",
    """SELECT event_id, user_id, event_type FROM events""",
)
def q_stream_dedup(spark, sf_dir):
    """The events arrive in five batches, in order of time.  Each batch also repeats the last half hour of the
    one before (within the delay, so the state knows them) and, from the fourth on, all of the one three before (too
    late for the watermark).  Every run resumes the state of the last one."""
    ev = tables.table(spark, sf_dir, "events")
    lo, hi = ev.select(F.min("ts"), F.max("ts")).first()
    if lo is None:
        return ev.select("event_id", "user_id", "event_type")
    name = _stream_name("dedup", sf_dir)
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-input"
    step = (hi - lo) / STREAM_BATCHES
    edge = [lo + k * step for k in range(STREAM_BATCHES)] + [hi + datetime.timedelta(microseconds=1)]
    within = lambda a, b: (F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))
    for k in range(STREAM_BATCHES):
        batch = ev.filter(within(edge[k], edge[k + 1]))
        if k:
            batch = batch.unionByName(ev.filter(within(max(edge[k - 1], edge[k] - datetime.timedelta(minutes=30)), edge[k])))
        if k >= 3:
            batch = batch.unionByName(ev.filter(within(edge[k - 3], edge[k - 2])))
        batch.write.mode("append").parquet(folder)
        s = stream.dedup_stream(spark.readStream.schema(ev.schema).parquet(folder), id="event_id", ts="ts")
        out = stream.run_to_table(spark, s.select("event_id", "user_id", "event_type"), name)
    return out


# ---------------------------------------------------------------------------
# Search, noise, lemmas
# ---------------------------------------------------------------------------

from spate.operators import search  # noqa: E402

# Extra search terms (the "(extra) OR ..." extension) that occur in the prose.
SEARCH_EXTRA = ["that the", "eaux"]


@register(
    "keyword_search",
    f"""SELECT doc_id AS id, lang FROM documents
WHERE regexp_matches(lower(text), '{search.keyword_pattern(search.FLOOD_TERMS + SEARCH_EXTRA)}')""",
)
def q_keyword_search(spark, sf_dir):
    docs = tables.documents_as_posts(spark, sf_dir)
    return search.keyword_search(docs, extra=SEARCH_EXTRA).select("id", "lang")


@register(
    "strip_noise",
    f"""SELECT doc_id AS id, regexp_replace(text, '{tx.noise_pattern().replace("'", "''")}', ' ', 'g') AS text FROM documents""",
)
def q_strip_noise(spark, sf_dir):
    docs = tables.documents_as_posts(spark, sf_dir)
    return docs.select("id", tx.strip_noise("text").alias("text"))


@register(
    "lemmatise",
    f"""WITH {CLEAN_DOCS_SQL}
SELECT id, array_to_string(list_transform(string_split(text, ' '), lambda w: coalesce({_lemma_map_sql()}[w], w)), ' ') AS doc
FROM cleaned""",
)
def q_lemmatise(spark, sf_dir):
    table = dict(phrases.SAMPLE_LEMMAS)
    lem = spark.createDataFrame(sorted(table.items()), "token string, lemma string")
    docs = phrases.lemmatise(document_tokens(spark, sf_dir), lem)
    return docs.select("id", F.array_join("tokens", " ").alias("doc"))


@register("topic_coherence")
def q_topic_coherence(spark, sf_dir):
    docs = document_tokens(spark, sf_dir, reuse=True)
    model, _ = topic_model.fit_documents(docs, k=LDA_TOPICS, seed=1)
    top = topic_model.top_terms(model, 10)
    return phrases.umass_coherence(docs, top)


@register("average_coherence")
def q_average_coherence(spark, sf_dir):
    return phrases.average_coherence(q_topic_coherence(spark, sf_dir))


@register(
    "top_similar_turns",
    f"""WITH part AS (
    SELECT conv_id AS id, concat_ws(':', turn, role) AS phrase, unnest(string_split({tx.sql_clean_text('text')}, ' ')) AS term FROM conversations),
counts AS (SELECT id, phrase, term, count(*) AS n FROM part WHERE term <> '' GROUP BY ALL),
whole AS (SELECT id, term, sum(n)::BIGINT AS m FROM counts GROUP BY ALL),
size AS (SELECT id, sum(m * m)::BIGINT AS mm FROM whole GROUP BY id),
dots AS (SELECT id, phrase, sum(n * m)::BIGINT AS nm, sum(n * n)::BIGINT AS nn FROM counts JOIN whole USING (id, term) GROUP BY ALL),
scored AS (SELECT id, phrase, nm / (sqrt(nn) * sqrt(mm)) AS similarity FROM dots JOIN size USING (id))
SELECT id, phrase, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, phrase) AS rank
FROM scored QUALIFY rank <= 2""",
)
def q_top_similar_turns(spark, sf_dir):
    """K5 on conversations: the two turns closest to their whole conversation, by exact term counts."""
    conv = tables.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("id"), F.concat_ws(":", "turn", "role").alias("phrase"),
        tx.tokens(tx.clean_text("text")).alias("tokens"),
    )
    return similarity.top_similar_texts(conv, n=2)
