"""The exact test's tiles: what travels, and results whatever the tile and chunk sizes."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spate.operators import lsh, similarity


def _rows(spark, n, kind="float", d=6):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(n, d)).astype(np.float32)
    v[n // 2 :] = v[: n - n // 2] + rng.normal(size=(n - n // 2, d)).astype(np.float32) * np.float32(0.2)
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    return df.withColumn("ord", F.col("id")), v.astype(np.float64)


def test_a_row_of_a_crowded_cell_travels_once_and_floats_stay_floats(spark):
    df, _ = _rows(spark, 4000)
    def side():
        rows = df.select(F.col("id").alias("__id"), F.col("ord").alias("__o"), similarity.own_vectors(df, "embedding").alias("__vec"))
        return rows.withColumns({"__nrm": F.lit(1.0), "__bx": F.lit(0), "__by": F.lit(0)})

    def seen(p, e):
        return pd.DataFrame({"n": [len(p) + len(e)], "size": [p["__vec"].iloc[0].itemsize]})

    got = similarity.tile_cogroups(side(), side()).applyInPandas(seen, schema="n long, size long").collect()
    assert sum(r["n"] for r in got) == 2 * 4000 and {r["size"] for r in got} == {4}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_results_do_not_depend_on_tiles_and_chunks(spark, monkeypatch, kind):
    df, v = _rows(spark, 300, kind)
    monkeypatch.setattr(similarity, "TILE", 64)
    monkeypatch.setattr(similarity, "CHUNK", 7)
    cos = v @ v.T / np.outer(np.linalg.norm(v, axis=1), np.linalg.norm(v, axis=1))
    like = cos > 0.9
    kept = {i for i in range(300) if not like[i, :i].any()}
    assert {r["id"] for r in similarity.drop_near_duplicates(df, thr=0.9).collect()} == kept
    assert kept <= {r["id"] for r in lsh.drop_near_duplicates_lsh(df, thr=0.9).collect()}
    asked = df.filter("id % 10 = 0")
    want = {(i, j): cos[i, j] for i in range(0, 300, 10) for j in np.flatnonzero(like[i]) if i != j}
    got = {(r["query"], r["id"]): r["cosine"] for r in similarity.similar_rows(asked, df, thr=0.9).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    found = {(r["query"], r["id"]): r["cosine"] for r in lsh.similar_rows_lsh(asked, df, thr=0.9).collect()}
    assert found.keys() <= want.keys() and len(found) >= 0.9 * len(want)
