"""Connected components of an edge table by alternating large-star and small-star
steps (Kiveris et al., 2014): logarithmic rounds, no round limit, each round a
partial aggregate and a join; intermediate edges are written to shared storage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spate.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every (larger / smaller) neighbour of a node to the least of its neighbourhood."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # a > b holds for every edge: u looks at its smaller neighbours only
        both = both.select("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(id, component) for every node of the edges (a, b); component = least id of the component.

    ``keep`` writes a round's edges to shared storage and reads them back."""
    cur = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        cur = keep(_star(_star(cur, True), False))
        # Done when every edge leads straight to a root: no target is a source, no source has two targets.
        ends = cur.select("a", F.lit(1).alias("out")).unionByName(cur.select(F.col("b").alias("a"), F.lit(0).alias("out")).distinct())
        node = ends.groupBy("a").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("k"))
        if not node.filter("out > 1 or (out = 1 and k > 1)").limit(1).count():
            break
    return cur.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionByName(
        cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
