"""Paged lists of posts per user, bar and cluster."""

import datetime

from spate.operators import dedup
from spate.operators.groups import paged_lists


def test_a_user_with_a_third_of_all_rows(spark):
    rows = [(i, None if i % 31 == 5 else i % 7 if i % 3 else 99, (i * 37) % 50, None if i % 11 == 0 else f"p{i % 4}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, user long, at int, loc string").repartition(5)
    got = {}
    for r in dedup.user_posts(df, user="user", ts="at", loc="loc", size=30).collect():
        assert r["n"] == len(r["posts"]) <= 30
        got[r["user"], r["page"]] = [tuple(p) for p in r["posts"]]
    want = {}
    for u in {r[1] for r in rows if r[1] is not None}:
        mine = sorted((a, i, loc) for i, v, a, loc in rows if v == u)
        want.update({(u, k): mine[30 * k : 30 * k + 30] for k in range((len(mine) + 29) // 30)})
    assert got == want and sum(len(v) for (u, _), v in got.items() if u == 99) > 180


def test_empty_and_other_types(spark):
    assert paged_lists(spark.createDataFrame([], "id long, k string"), ["k"], ["id"], ["id"]).count() == 0
    day = datetime.date(2020, 1, 1)
    out = paged_lists(spark.createDataFrame([(2, day), (1, day)], "id long, k date"), ["k"], ["id"], ["id"]).collect()
    assert [(r["k"], r["page"], r["n"], [p["id"] for p in r["posts"]]) for r in out] == [(day, 0, 2, [1, 2])]
