"""DBSCAN and near-duplicate removal against brute force on small fixtures."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from spate.operators import cluster, similarity


def _brute_dbscan(vecs, eps, min_samples):
    ids = sorted(vecs)
    nb = {i: [j for j in ids if np.linalg.norm(vecs[i] - vecs[j]) <= eps + 1e-12] for i in ids}
    core = {i for i in ids if len(nb[i]) >= min_samples}
    comp = {}
    for c in sorted(core):
        if c in comp:
            continue
        stack, comp[c] = [c], c
        while stack:
            x = stack.pop()
            for y in nb[x]:
                if y in core and y not in comp:
                    comp[y] = c
                    stack.append(y)
    order = sorted(set(comp.values()))
    num = {c: k for k, c in enumerate(order)}
    out = {}
    for i in ids:
        if i in core:
            out[i] = num[comp[i]]
        else:
            cl = [num[comp[j]] for j in nb[i] if j in core]
            out[i] = min(cl) if cl else -1
    return out


def test_dbscan_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"t{k}" for k in range(12)]
    rows, vecs = [], {}
    for i in range(40):
        terms = rng.sample(vocab, rng.randint(1, 4))
        w = np.array([rng.random() + 0.1 for _ in terms])
        w = w / np.linalg.norm(w)
        v = np.zeros(len(vocab))
        for t, x in zip(terms, w):
            rows.append((i, t, float(x)))
            v[vocab.index(t)] = x
        vecs[i] = v
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    ids = spark.createDataFrame([(i,) for i in range(40)], "id long")
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(weights, ids, eps=0.9, min_samples=3).collect()}
    assert got == _brute_dbscan(vecs, 0.9, 3)


def test_neighbour_pairs_hot_and_rare_paths(spark):
    rng = random.Random(11)
    vocab = [f"t{k}" for k in range(15)]
    rows, vecs = [], {}
    for i in range(60):
        # a few very common terms (hot) plus rarer ones
        terms = sorted(set(rng.sample(vocab[:4], 2) + rng.sample(vocab, rng.randint(1, 3))))
        w = np.array([rng.random() + 0.1 for _ in terms])
        w = w / np.linalg.norm(w)
        v = np.zeros(len(vocab))
        for t, x in zip(terms, w):
            rows.append((i, t, float(x)))
            v[vocab.index(t)] = x
        vecs[i] = v
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    want = {(i, j) for i in vecs for j in vecs if i != j and vecs[i] @ vecs[j] >= 0.6}
    for hot_df, tile in ((3, 8), (1000, 2048), (3, 2048)):
        got = {(r["a"], r["b"]) for r in cluster.neighbour_pairs(weights, 0.6, hot_df=hot_df, tile_size=tile).collect()}
        assert got == want, (hot_df, tile)


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = []
    k = 0
    for b in base:
        for _ in range(5):  # a group of copies and near copies per base vector
            v = b + rng.normal(scale=0.3, size=8)
            rows.append((k, [float(x) for x in v]))
            k += 1
    rows.append((k, [0.0] * 8))  # zero vector: never dropped
    rows.append((k + 1, rows[0][1]))  # exact copy of row 0
    df = spark.createDataFrame(rows, "id long, embedding array<float>").withColumn("ord", F.col("id"))
    for thr in (0.8, 0.95):
        got = {r["id"] for r in similarity.drop_near_duplicates(df, thr=thr).collect()}
        arr = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows}
        want = set()
        for j in arr:
            nj = np.linalg.norm(arr[j])
            dropped = False
            for i in arr:
                ni = np.linalg.norm(arr[i])
                if i < j and ni > 0 and nj > 0 and arr[i] @ arr[j] / (ni * nj) > thr:
                    dropped = True
                    break
            if not dropped:
                want.add(j)
        assert got == want
        assert math.isfinite(thr)


def test_components_of_a_long_chain(spark):
    ids = spark.range(1000, 1500).select("id")
    edges = spark.range(1000, 1450).selectExpr("id AS a", "id + 1 AS b")
    got = {r["id"]: r["comp"] for r in cluster.connected_components(ids, edges).collect()}
    assert got == {i: 1000 if i <= 1450 else i for i in range(1000, 1500)}


def test_tile_dots_in_dense_and_sparse_blocks():
    from spate.operators.cluster import tile_dots

    rng = np.random.default_rng(2)
    a = rng.random((30, 50)) * (rng.random((30, 50)) < np.linspace(0.02, 0.9, 50))
    b = rng.random((20, 50)) * (rng.random((20, 50)) < np.linspace(0.02, 0.9, 50))
    (lr, lt), (rr, rt) = a.nonzero(), b.nonzero()
    for hot_df, max_hot in ((3, 8), (0, 1), (10**6, 8), (10, 1024)):
        got = tile_dots(lr, lt, a[lr, lt], rr, rt, b[rr, rt], (30, 20), hot_df, max_hot)
        assert np.allclose(got, a @ b.T, atol=1e-12)
    none = np.zeros(0, dtype=np.int64)
    assert not tile_dots(none, none, none * 1.0, rr, rt, b[rr, rt], (30, 20)).any()


def test_neighbour_pairs_small_dense_blocks(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE_ENTRIES", 60)  # many tiles by entries alone
    rng = random.Random(7)
    vecs = {}
    for i in range(70):
        terms = sorted(set(rng.sample(range(4), 2) + rng.sample(range(40), 3)))
        v = np.zeros(40)
        v[terms] = [rng.random() + 0.1 for _ in terms]
        vecs[i] = v / np.linalg.norm(v)
    rows = [(i, f"t{k}", float(x)) for i, v in vecs.items() for k, x in enumerate(v) if x]
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    want = {(i, j) for i in vecs for j in vecs if i != j and vecs[i] @ vecs[j] >= 0.5}
    for hot_df, max_hot in ((1, 8), (10**6, 8)):
        pairs = cluster.neighbour_pairs(weights, 0.5, hot_df=hot_df, max_hot=max_hot)
        assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # no join on a term


def _planted(rng, n, d, groups):
    """Random rows, then groups of near copies, then an exact-copy group; a null and a zero vector."""
    rows = [rng.normal(size=d) for _ in range(n)]
    for g in range(groups):
        base = rng.normal(size=d)
        rows += [base + rng.normal(scale=0.15, size=d) for _ in range(8)]
    rows += [rows[0]] * 300
    out = [(i, [float(x) for x in v], i) for i, v in enumerate(rows)]
    return out + [(len(out), None, len(out)), (len(out) + 1, [0.0] * d, len(out) + 1), (len(out) + 2, [1.0] * d, None)]


def test_lsh_drops_what_the_exact_mode_drops(spark, monkeypatch):
    from spate.operators import lsh

    rows = _planted(np.random.default_rng(4), 500, 16, 30)
    df = spark.createDataFrame(rows, "id long, embedding array<double>, ord long")
    v = np.array([r[1] for r in rows[:-3]])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    similar = np.tril(u @ u.T > 0.8, -1)
    for plan in (None, lsh.LshPlan(8, 5, 3)):
        if plan:
            monkeypatch.setattr(lsh, "lsh_plan", lambda *a, p=plan: p)
        kept = {r["id"] for r in lsh.drop_near_duplicates_lsh(df).collect()}
        exact = {i for i in range(len(v)) if not similar[i].any()}
        assert {r[0] for r in rows[-3:]} <= kept
        assert exact <= kept  # nothing is dropped without a similar earlier row
        lost = kept - exact - {r[0] for r in rows[-3:]}
        assert len(lost) <= 0.1 * (len(v) - len(exact))


def test_lsh_recall_against_brute_force(spark, monkeypatch):
    from spate.operators import lsh

    rows = _planted(np.random.default_rng(9), 400, 16, 40)[:-1]
    df = spark.createDataFrame(rows, "id long, embedding array<double>, ord long")
    asked = df.filter("id % 10 = 0")
    true = {(r["query"], r["id"]): r["cosine"] for r in similarity.similar_rows(asked, df, thr=0.8).collect()}
    v = {i: np.array(e) for i, e, _ in rows if e and any(e)}
    want = {(i, j) for i in v if i % 10 == 0 for j in v if i != j and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) > 0.8}
    assert set(true) == want
    monkeypatch.setattr(lsh, "lsh_plan", lambda *a: lsh.LshPlan(9, 6, 1))
    got = {(r["query"], r["id"]): r["cosine"] for r in lsh.similar_rows_lsh(asked, df, thr=0.8).collect()}
    assert set(got) <= want and len(got) >= 0.9 * len(want)
    assert all(math.isclose(got[k], true[k], abs_tol=1e-12) for k in got)


def test_lsh_plan_keeps_its_recall():
    from spate.operators.lsh import lsh_plan

    for n in (100, 10**5, 10**9):
        plan = lsh_plan(n, 0.8, 0.95)
        p, b = 1 - math.acos(0.8) / math.pi, plan.bits
        found = p**b + b * p ** (b - 1) * (1 - p)
        assert 1 - (1 - found) ** plan.tables >= 0.95
    assert lsh_plan(10**9, 0.8).bits > lsh_plan(10**5, 0.8).bits
