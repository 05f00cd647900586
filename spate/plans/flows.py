"""Composite plans C1–C4: the operators wired end to end.

Each returns DataFrames (lazily planned); the only eager steps are model fits
and reliable checkpoints at fan-out points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spate.functions import text as tx
from spate.operators import classify, clean, cluster, dedup, geo, search, terms, views
from spate.session import cut_lineage


def locate_posts(posts: DataFrame, model, gazetteer: DataFrame, country: str = "SE", terms_=None, start=None, end=None) -> DataFrame:
    """Posts → keyword search (F1) → clean (T3) → score (M18) → relevant
    (F4) → toponyms (J3) → resolve (J4) → smallest place (A11) → flatten (F13)
    → one post per user, week and place (A3)."""
    found = search.keyword_search(posts, terms=terms_ or search.FLOOD_TERMS, start=start, end=end)
    cleaned = cut_lineage(clean.clean_posts(found, order="id"))
    scored = classify.predict(cleaned.withColumn("tokens", tx.tokens("text")), model)
    relevant = search.relevant_only(scored)
    tops = geo.resolve_toponyms(geo.extract_toponyms(relevant, gazetteer, text="text_raw", country=country), gazetteer, country)
    best = geo.flatten_location(geo.smallest_location(tops))
    located = relevant.drop("tokens", "probability").join(best, "id")
    return dedup.one_per_user_week(located, loc="loc_name")


def train_relevance(labelled_sets, label: str = "relevant", seed: int = 0, balance: bool = False):
    """Labelled sets → union (U1) → optional under-sampling (M15) → exact
    split (M16) → clean + train (M17) → test metrics (A17, A18).
    Returns ``(model, confusion, metrics)``."""
    if label not in classify.LABELS:
        raise ValueError(f"{label} is not a supported label")
    data = views.union_labelled(labelled_sets, label)
    if balance:
        data = classify.undersample(data, "label", seed=seed)
    data = clean.clean_posts(data, order="id", dedup=False).withColumn("tokens", tx.tokens("text"))
    data = classify.split(data, seed=seed)
    model = classify.train(data.filter(F.col("split") == "train"), label="label")
    scored = classify.predict(data.filter(F.col("split") == "test"), model)
    return model, classify.confusion(scored), classify.binary_metrics(scored)


def selection_views(posts: DataFrame, spec: dict | None, docs: DataFrame | None = None, zoom: int = 5) -> dict[str, DataFrame]:
    """Selection (U3) → histogram (A7), summary (A9), location counts
    (A10), map clusters (A14), first table page (K1) and, when token lists are
    given, top TF-IDF terms of the selection fitted on all posts (M6)."""
    sel = views.select_posts(posts, spec)
    ids = sel.select("id")
    out = {
        "histogram": views.time_histogram(posts, ids),
        "summary": views.summary(posts, posts.filter(F.col("loc_name").isNotNull()), sel),
        "locations": views.location_counts(sel),
        "clusters": geo.grid_clusters(sel, zoom=zoom),
        "page": views.page(sel),
    }
    if docs is not None:
        out["top_terms"] = terms.top_terms(docs.join(ids, "id", "left_semi"), all_docs=docs)
    return out


def geoparse_evaluation(posts: DataFrame, gazetteer: DataFrame, actual: str = "mentions_location", country: str = "SE") -> dict[str, DataFrame]:
    """C4: relevant annotated posts → toponyms (J3) → resolve (J4) → has a
    place (F9) → confusion (A17), metrics (A18) and error slices (F16)."""
    rel = posts.filter(F.col("relevant") == 1)
    tops = geo.resolve_toponyms(geo.extract_toponyms(rel, gazetteer, country=country), gazetteer, country)
    has = geo.has_location(tops)
    judged = rel.join(has, "id", "left").withColumn("has_location", F.coalesce("has_location", F.lit(False)))
    pred = judged.withColumn("predicted_label", F.col("has_location").cast("int")).withColumn("label", F.col(actual))
    return {
        "confusion": classify.confusion(pred),
        "metrics": classify.binary_metrics(pred),
        "slices": classify.error_slices(classify.outcome(judged, actual=actual)),
    }


def cluster_documents(docs: DataFrame, eps: float = 1.2, min_samples: int = 2) -> DataFrame:
    """DBSCAN (M11) of cleaned post texts over smooth TF-IDF rows (M5)."""
    w = terms.tfidf_smooth(docs, id="id", text="text")
    return cluster.dbscan(w, docs.select("id"), eps=eps, min_samples=min_samples)
