"""Property checks on generated inputs."""

import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spate.operators import classify, clean, dedup, views

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

words = st.sampled_from(["flood", "rain", "the", "road", "Gävle", "RT", "water", "#x", "@y", "12"])
texts = st.lists(words, min_size=0, max_size=5).map(" ".join)
rows = st.lists(st.tuples(st.integers(0, 10_000), texts), min_size=1, max_size=25, unique_by=lambda r: r[0])


@SETTINGS
@given(rows)
def test_clean_posts_idempotent_and_unique(spark, data):
    df = spark.createDataFrame(data, "id long, text string")
    once = clean.clean_posts(df, order="id").select("id", "text")
    twice = clean.dedup_text(once, "text", "id")
    a = sorted(map(tuple, once.collect()))
    assert a == sorted(map(tuple, twice.collect()))
    assert len({t for _, t in a}) == len(a)
    # the survivor of each text is its smallest id
    by_text = {}
    for i, t in map(tuple, clean.clean_posts(df, order="id", dedup=False).select("id", "text").collect()):
        by_text[t] = min(i, by_text.get(t, i))
    assert dict((t, i) for i, t in a) == by_text


events = st.lists(
    st.tuples(st.integers(0, 500), st.integers(0, 60 * 24 * 40), st.sampled_from([1, 2, 3, None]), st.sampled_from(["a", "b", None])),
    min_size=1, max_size=30, unique_by=lambda r: r[0],
)


def _events(spark, data):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=m), u, loc) for i, m, u, loc in data]
    return spark.createDataFrame(rows, "id long, created_at timestamp, user_id long, loc_name string")


@SETTINGS
@given(events)
def test_one_per_user_week_idempotent(spark, data):
    df = _events(spark, data)
    once = dedup.one_per_user_week(df, loc="loc_name")
    twice = dedup.one_per_user_week(once.drop("week"), loc="loc_name")
    assert sorted(r["id"] for r in once.collect()) == sorted(r["id"] for r in twice.collect())


@SETTINGS
@given(events, st.sets(st.integers(0, 500), max_size=10))
def test_histogram_sums_and_split_partition(spark, data, chosen):
    df = _events(spark, data)
    ids = spark.createDataFrame([(i,) for i in sorted(chosen)], "id long")
    h = views.time_histogram(df, ids).collect()
    assert sum(r["n"] for r in h) == len(data)
    sel, rest = views.split_selection(df, ids)
    s_ids = {r["id"] for r in sel.collect()}
    r_ids = {r["id"] for r in rest.collect()}
    assert s_ids.isdisjoint(r_ids) and s_ids | r_ids == {d[0] for d in data}


labelled = st.lists(st.tuples(st.integers(0, 10_000), st.integers(0, 1)), min_size=2, max_size=40, unique_by=lambda r: r[0])


@SETTINGS
@given(labelled, labelled)
def test_union_counts_and_undersample_balance(spark, a, b):
    da = spark.createDataFrame([(i, "t", y) for i, y in a], "id long, text string, relevant int")
    db = spark.createDataFrame([(i, "t", y) for i, y in b], "id long, text string, relevant int")
    u = views.union_labelled([da, db], "relevant")
    assert u.count() == len(a) + len(b)
    us = classify.undersample(u.dropDuplicates(["id"]), "label", seed=5)
    counts = [r["count"] for r in us.groupBy("label").count().collect()]
    if len(counts) == 2:
        assert counts[0] == counts[1]


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 1)), min_size=1, max_size=40))
def test_metrics_recomputed_from_confusion(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, predicted_label int")
    cells = {(r["actual"], r["predicted"]): r["n"] for r in classify.confusion(df).collect()}
    m = classify.binary_metrics(df).first()
    tp, tn, fp, fn = cells[(1, 1)], cells[(0, 0)], cells[(0, 1)], cells[(1, 0)]
    assert (m["tp"], m["tn"], m["fp"], m["fn"]) == (tp, tn, fp, fn)
    assert m["accuracy"] == (tp + tn) / len(pairs)
    assert m["precision"] == (tp / (tp + fp) if tp + fp else None)
    assert m["f1"] == (tp / (tp + 0.5 * (fp + fn)) if tp + fp + fn else None)
    assert F is not None
