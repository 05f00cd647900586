"""What the operators write to disk: shuffles, checkpoints, copies of rows."""

import os

import pytest
from pyspark.sql import functions as F

from spate import session
from spate.operators import blocks, geo, lsh, phrases, terms


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark, n=30):
    rows = [(i, f"alpha beta gamma w{i} w{i} alpha beta delta v{i % 7}".split()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, tokens array<string>")


@pytest.mark.parametrize("sent", [500_000, 0])
def test_bigrams_are_applied_where_the_tokens_lie(spark, monkeypatch, sent):
    monkeypatch.setattr(phrases, "BIGRAM_SENT_PHRASES", sent)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = _texts(spark)
        got = phrases.bigram_positions(docs, phrases.bigram_phrases(docs, min_count=5, threshold=0.0))
        assert ("BroadcastHashJoin" in _plan(got)) == (sent > 0)
        found = sorted(tuple(r) for r in got.filter("id = 3").collect())
        assert found == [(3, 0, "alpha_beta"), (3, 5, "alpha_beta")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffles_of_a_checkpointed_job_are_freed_and_the_setting_stays(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with session.shuffles_freed(spark):
        assert spark.conf.get(key) == "true"
    df = session.cut_lineage(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
    assert spark.conf.get(key) == before and df.count() == 7
    path = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.exists(path)
    session.release(df)
    assert not os.path.exists(path)
    assert session.stored(spark.range(5).select(F.array("id").alias("a"))).count() == 5


def test_ngrams_travel_once_and_are_in_order(spark):
    rows = [(["a", "b", "c", "d"],), (["b", "c", "d", None, "e"],), (["a", "b"],), ([],), (None,), (["z", "b", "c"],)]
    docs = spark.createDataFrame(rows, "tokens array<string>")
    got = phrases.ngram_vocabulary(docs, n=2)
    want = {}
    for (t,) in rows:
        for x, y in zip(t or [], (t or [])[1:]):
            g = " ".join(w for w in (x, y) if w is not None)
            want[g] = want.get(g, 0) + 1
    assert [tuple(r) for r in got.collect()] == sorted(want.items(), key=lambda x: (-x[1], x[0]))
    # Nothing is dealt out by hash and then again by order.
    assert "hashpartitioning(ngram" not in _plan(got)


@pytest.mark.parametrize("words", [1, 7, 500_000])
def test_rake_scores_phrases_where_they_lie(spark, monkeypatch, words):
    texts = [(i, f"big red river{i % 5}, the slow river{i % 3} of big rain. Red river flood big big rain") for i in range(20)] + [(1, "slow rain"), (None, "red rain")]
    df = spark.createDataFrame(texts, "id long, text string")
    want = [tuple(r) for r in phrases.rake(df, n=50).collect()]
    monkeypatch.setattr(phrases, "RAKE_SENT_WORDS", words)
    got = phrases.rake(df.filter("id > 1"), n=50)
    assert "Join" not in _plan(got) and got.count() > 5
    assert [tuple(r) for r in phrases.rake(df, n=50).collect()] == want


def test_lsh_sends_few_copies_of_the_rows_at_once(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(300, 8))
    v = np.concatenate([v, v[:100] + 0.01]).tolist()
    df = spark.createDataFrame([(i, i, x) for i, x in enumerate(v)], "id long, ord long, embedding array<double>")
    plan = lsh.LshPlan(bits=4, tables=5, seed=1)
    monkeypatch.setattr(lsh, "lsh_plan", lambda *a: plan)
    sent, codes = [], lsh._codes
    monkeypatch.setattr(lsh, "_codes", lambda rows, plan, d, probes, tables=None: sent.append(len(tables or range(plan.tables)) * (1 + plan.bits * probes)) or codes(rows, plan, d, probes, tables))
    kept = [sorted(r["id"] for r in lsh.drop_near_duplicates_lsh(df, thr=0.9, recall=0.999).collect())]
    monkeypatch.setattr(lsh, "MOST_COPIES", 1)
    monkeypatch.setattr(lsh, "MOST_CELLS", 0)
    sent.clear()
    kept.append(sorted(r["id"] for r in lsh.drop_near_duplicates_lsh(df, thr=0.9, recall=0.999).collect()))
    assert max(sent) == plan.bits + 1
    assert kept[0] == kept[1] and set(range(300, 400)).isdisjoint(kept[0])


def test_toponym_hits_are_dealt_out_by_post_once(spark):
    posts = spark.createDataFrame([(1, "In New York City, new york and York!"), (3, "new york"), (None, "York new"), (2, None)], "id long, text string")
    places = spark.createDataFrame(
        [(n, "US", i, 0.5) for i, n in enumerate(["New York", "York", "New York City", "city"])], "name string, country_code string, place_id long, importance double"
    )
    got = geo.extract_toponyms(posts, places)
    assert _plan(got).count("hashpartitioning(id") == 1
    want = [(1, 1, "New York City,"), (1, 4, "new york"), (1, 7, "York!"), (3, 0, "new york"), (None, 0, "York")]
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_rounds_leave_one_table(spark):
    import numpy as np

    from spate.operators.spectral import leading_vectors

    rng = np.random.default_rng(2)
    m = rng.random((40, 120)) * (rng.random((40, 120)) < 0.3)
    rows = [(int(i), f"t{j}", float(m[i, j])) for i, j in zip(*m.nonzero())]
    folder = session.ensure_checkpoint_dir(spark).removeprefix("file:")
    count = lambda: sum(len([f for f in files if f.startswith("part-")]) > 0 for _, _, files in os.walk(folder))
    packed = blocks.of_entries(spark.createDataFrame(rows, "id long, term string, weight double"))
    before = count()
    leading_vectors(packed, 2)
    assert count() - before <= 1


def test_weights_in_blocks_equal_the_rows(spark):
    docs = _texts(spark).unionAll(spark.createDataFrame([(None, ["alpha", "x"]), (99, [])], "id long, tokens array<string>"))
    rows = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(docs).collect()}
    packed = terms.tfidf(docs, in_blocks=True)
    want = {}
    for (_, t), w in rows.items():
        want[t] = want.get(t, 0) + w
    assert {r["term"]: r["total"] for r in packed.totals().collect()} == pytest.approx(want)
    from spate.operators import topics

    a, b = ([tuple(r) for r in topics.lsi(w, k=2).orderBy("component", "rank").collect()] for w in (terms.tfidf(docs), packed))
    assert len(a) == len(b) and all(x[2] == pytest.approx(y[2], abs=1e-6) for x, y in zip(a, b))
    assert {x[:1] + (round(x[3], 8),) for x in a} == {x[:1] + (round(x[3], 8),) for x in b}
