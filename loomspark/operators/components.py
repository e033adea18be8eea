"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.scratch import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs the larger neighbours of a node (large), or its lesser ones and itself, on the least of them."""
    near = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = near.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("m"))
    joined = near.join(least, "src")
    if large:
        out = joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst")))
    return out.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component), the least id reached, of all nodes on edges (src, dst), and of nodes (id) where given."""
    cur = materialize(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), "pairs")
    mark = None
    while True:
        cur = materialize(_star(_star(cur, True), False), "stars")
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    found = cur.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(cur.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct())
    if nodes is None:
        return found
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
