"""Vector similarity: near-duplicate removal and per-document top-n.

J8 ``drop_near_duplicates``: a row goes when **any** earlier row (kept or not)
has cosine similarity above the threshold.  Exact, in three distributed steps:

1. *Copy collapse.*  Unit vectors are snapped to a fine grid whose cells have a
   diameter below the threshold distance ``r = sqrt(2 - 2·thr)``; two rows in
   one cell are certainly similar, so every row but the earliest of its cell
   goes.  A partial aggregate: a copy group holding a third of all rows is
   combined map-side and leaves a single leader.
2. *Blocking.*  Leaders are keyed by a 2-D grid over their first two principal
   components (cell side ``r``).  Projection onto orthonormal directions never
   increases a distance, so a similar pair always sits in the same or an
   adjacent cell: the blocking loses no pair.
3. *Exact test.*  Each leader (replicated to its 9 neighbour cells) is
   compared with every earlier row of those cells on the exact cosine.  The
   comparisons run in bounded tiles — rows of a cell are hashed into tiles of
   about ``TILE`` rows and each (probe tile, earlier tile) pair is one
   cogrouped pandas call doing a numpy matrix product — so a crowded cell is
   spread over many tasks and no pair table is materialised.  Rows with a zero
   or NULL vector have no defined cosine and are always kept.

K5 ``top_similar``: per document the ``n`` candidate phrases closest to the
document vector (candidates belong to their document, as keyword extraction
does), ranked inside each document; ``top_similar_texts`` does the same on
exact sparse term counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double_array(c) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.transform(col, lambda x: x.cast("double"))


def own_vectors(df: DataFrame, vec: str) -> Column:
    """The vectors as they travel: floats stay floats, half the bytes; everything else is cast to double.

    Sums and products are taken after a cast to double, which is exact."""
    kind = df.schema[vec].dataType
    return F.col(vec) if kind == T.ArrayType(T.FloatType(), kind.containsNull) else as_double_array(vec)


def dot(a: Column, b: Column) -> Column:
    """Σ aᵢ·bᵢ, summed left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """dot(a, b) / (‖a‖·‖b‖) (NULL-safe division)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def _project(u: Column, component: list[float]) -> Column:
    return dot(u, F.array(*[F.lit(float(x)) for x in component]))


def drop_near_duplicates(
    df: DataFrame,
    vec: str = "embedding",
    order: str = "ord",
    id: str = "id",
    thr: float = 0.8,
) -> DataFrame:
    """J8 (exact): keep the rows with no earlier row of cosine > ``thr``."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    r = math.sqrt(max(2.0 - 2.0 * thr, 0.0))
    base = df.withColumn("__v", own_vectors(df, vec)).withColumn("__n", norm(as_double_array("__v")))
    undefined = base.filter(F.col("__n").isNull() | (F.col("__n") == 0)).drop("__v", "__n")
    nz = base.filter(F.col("__n") > 0).withColumn("__u", F.transform("__v", lambda x: x.cast("double") / F.col("__n")))

    # 1. copy collapse on a fine grid (cell diameter < r).
    width = F.lit(r * (1 - 1e-9)) / F.sqrt(F.size("__u").cast("double"))
    nz = nz.withColumn("__cell", F.transform("__u", lambda x: F.floor(x / width)))
    firsts = nz.groupBy("__cell").agg(F.min(F.struct(F.col(order).alias("o"), F.col(id).alias("i"))).alias("__f"))
    leader_ids = firsts.select(F.col("__f.i").alias(id))
    leaders = nz.join(leader_ids, id, "left_semi")

    # 2. blocking on two principal components of the unit vectors.
    pca = PCA(k=2, inputCol="__x", outputCol="__pc").fit(leaders.select(array_to_vector("__u").alias("__x")))
    comps = pca.pc.toArray().T.tolist()  # 2 × d, bounded by the dimension
    side = r if r > 0 else 1.0

    def keyed(frame):
        return frame.withColumn("__bx", F.floor(_project(F.col("__u"), comps[0]) / side)).withColumn(
            "__by", F.floor(_project(F.col("__u"), comps[1]) / side)
        )

    earlier = keyed(nz).select(
        "__bx", "__by", F.col(order).alias("__o"), F.col("__v").alias("__vec"), F.col("__n").alias("__nrm")
    )
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    probes = (
        keyed(leaders)
        .select(F.col(id).alias("__id"), F.col(order).alias("__o"), F.col("__v").alias("__vec"), F.col("__n").alias("__nrm"), "__bx", "__by", F.explode(offsets).alias("__d"))
        .select("__id", "__o", "__vec", "__nrm", (F.col("__bx") + F.col("__d.dx")).alias("__bx"), (F.col("__by") + F.col("__d.dy")).alias("__by"))
    )

    # 3. exact cosine test in bounded tiles: each cell's probes and earlier rows
    # are hashed into tiles of about TILE rows; every (probe tile, earlier tile)
    # pair of a cell is one cogroup evaluated as a numpy matrix product.
    dropped = _tiled_semi_join(probes, earlier, thr).select(F.col("__id").alias(id)).distinct()
    kept = leaders.join(dropped, id, "left_anti").drop("__v", "__n", "__u", "__cell")
    return kept.unionByName(undefined)


# Rows per side of one exact-test tile.  A row of a cell of n rows travels n / TILE times, so large tiles send little;
# a task holds two tiles of vectors and the cosines of CHUNK rows of the one with all of the other.
TILE = 8192
CHUNK = 256


def cosine_chunks(p, e):
    """(slice, cosines) of CHUNK rows of tile ``p`` after the other with all rows of tile ``e``, in doubles."""
    import numpy as np

    vp, ve = (np.stack(x["__vec"].to_numpy()).astype(np.float64) for x in (p, e))
    np_, ne = p["__nrm"].to_numpy(), e["__nrm"].to_numpy()
    for k in range(0, len(vp), CHUNK):
        at = slice(k, k + CHUNK)
        yield at, (vp[at] @ ve.T) / np.outer(np_[at], ne)


def similar_pairs(p, e, thr: float):
    """(query, id, cosine) of the rows of tile ``p`` with the other rows of tile ``e`` of cosine > ``thr``."""
    import numpy as np
    import pandas as pd

    out = [pd.DataFrame({"query": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "cosine": pd.Series([], dtype="float64")})]
    if not p.empty and not e.empty:
        asked, ids = p["__id"].to_numpy(), e["__id"].to_numpy()
        for at, cos in cosine_chunks(p, e):
            i, j = np.nonzero(cos > thr)
            out.append(pd.DataFrame({"query": asked[at][i], "id": ids[j], "cosine": cos[i, j]}))
    got = pd.concat(out[1:] or out)
    return got[got["query"] != got["id"]]


def later_like_earlier(p, e, thr: float):
    """(__id) of the rows of tile ``p`` with a row of smaller order and cosine > ``thr`` in tile ``e``."""
    import numpy as np
    import pandas as pd

    if p.empty or e.empty:
        return pd.DataFrame({"__id": pd.Series([], dtype="int64")})
    order, before = p["__o"].to_numpy(), e["__o"].to_numpy()
    hit = np.zeros(len(p), dtype=bool)
    for at, cos in cosine_chunks(p, e):
        hit[at] = ((cos > thr) & (before[None, :] < order[at][:, None])).any(axis=1)
    return pd.DataFrame({"__id": p["__id"].to_numpy()[hit].astype("int64")})


def tile_cogroups(probes: DataFrame, earlier: DataFrame, few: bool = False):
    """Cogroups of the rows of each cell (``__bx``, ``__by``): every tile of about TILE
    probe rows with every tile of rows to compare them with.  ``few``: the cells' counts
    are sent to every task, so that no vector is shuffled to meet its cell's count."""

    def tiles(frame, name):
        return frame.groupBy("__bx", "__by").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias(name))

    tp, te = tiles(probes, "__np"), tiles(earlier, "__ne")
    counts = tp.join(te, ["__bx", "__by"])  # cells with both sides only
    counts = F.broadcast(counts) if few else counts
    p = probes.join(counts, ["__bx", "__by"]).select(
        "*",
        F.pmod(F.xxhash64("__id"), F.col("__np")).cast("int").alias("__tp"),
        F.explode(F.sequence(F.lit(0), F.col("__ne") - 1)).alias("__te"),
    )
    e = earlier.join(counts, ["__bx", "__by"]).select(
        "*",
        F.pmod(F.xxhash64("__o"), F.col("__ne")).cast("int").alias("__te"),
        F.explode(F.sequence(F.lit(0), F.col("__np") - 1)).alias("__tp"),
    )
    keys = ["__bx", "__by", "__tp", "__te"]
    fields = ["__o", "__vec", "__nrm"]
    return (
        p.select(*keys, "__id", *fields)
        .groupBy(*keys)
        .cogroup(e.select(*keys, *(["__id"] if "__id" in e.columns else []), *fields).groupBy(*keys))
    )


def _tiled_semi_join(probes: DataFrame, earlier: DataFrame, thr: float) -> DataFrame:
    """Probe ids having an earlier row (smaller order) in the same cell with
    cosine > ``thr``.  Work per cogroup is bounded by TILE × TILE, its memory by CHUNK × TILE."""
    return tile_cogroups(probes, earlier).applyInPandas(lambda p, e: later_like_earlier(p, e, thr), schema="__id long")


def similar_rows(queries: DataFrame, df: DataFrame, vec: str = "embedding", id: str = "id", thr: float = 0.8) -> DataFrame:
    """(query, id, cosine): per query row all other rows of cosine > ``thr``, by brute force in tiles."""
    def side(frame):
        rows = frame.select(F.col(id).alias("__id"), F.col(id).alias("__o"), own_vectors(frame, vec).alias("__vec"))
        return rows.withColumn("__nrm", norm(as_double_array("__vec"))).filter("__nrm > 0").withColumns({"__bx": F.lit(0), "__by": F.lit(0)})

    pairs = tile_cogroups(side(queries), side(df))
    return pairs.applyInPandas(lambda p, e: similar_pairs(p, e, thr), schema="query long, id long, cosine double")


def top_similar(docs: DataFrame, candidates: DataFrame, n: int = 5, id: str = "id", vec: str = "embedding", phrase: str = "phrase") -> DataFrame:
    """K5: per document the ``n`` candidates (``(id, phrase, embedding)``, the
    document's own phrases) most similar to the document vector."""
    d = docs.select(F.col(id), as_double_array(vec).alias("__d"))
    c = candidates.select(F.col(id), F.col(phrase), as_double_array(vec).alias("__c"))
    scored = c.join(d, id).select(id, phrase, cosine(F.col("__c"), F.col("__d")).alias("similarity"))
    w = Window.partitionBy(id).orderBy(F.col("similarity").desc(), F.col(phrase))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_similar_texts(parts: DataFrame, n: int = 5, id: str = "id", phrase: str = "phrase", tokens: str = "tokens") -> DataFrame:
    """K5 on texts, exact: per document (``id``) the ``n`` parts closest to the whole by the cosine of their term counts.

    ``parts(id, phrase, tokens)``; parts of one id and phrase count as one, the whole is the sum of its parts, and
    parts without tokens have no direction and are left out.  Counts are joined per (id, term), so no vector is
    built and no two terms share a slot; the sums are integers.  The rank limit acts in every task before the
    rows of a document meet (Spark's window group limit).
    """
    counts = (
        parts.select(F.col(id).alias("id"), F.col(phrase).alias("phrase"), F.explode(tokens).alias("term"))
        .groupBy("id", "phrase", "term").agg(F.count(F.lit(1)).alias("n"))
    )
    whole = counts.groupBy("id", "term").agg(F.sum("n").alias("m"))
    size = whole.groupBy("id").agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    dots = counts.join(whole, ["id", "term"]).groupBy("id", "phrase").agg(
        F.sum(F.col("n") * F.col("m")).alias("nm"), F.sum(F.col("n") * F.col("n")).alias("nn")
    )
    scored = dots.join(size, "id").select(
        F.col("id").alias(id), F.col("phrase").alias(phrase), (F.col("nm") / (F.sqrt("nn") * F.sqrt("mm"))).alias("similarity")
    )
    w = Window.partitionBy(id).orderBy(F.col("similarity").desc(), F.col(phrase))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
