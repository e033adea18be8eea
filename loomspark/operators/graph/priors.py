"""What the graph says about chunks: priors by path, communities by path, and the impact of changed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.model import DEPENDENCY_KINDS
from loomspark.operators.graph import betweenness as between
from loomspark.operators.graph import community, traverse, walk
from loomspark.operators.graph.store import Store

NAMES_A_TERM, BRIDGE_SHARE = 4, 0.5


def seeds_of(store: Store, query: str | None) -> DataFrame:
    """(id) of the nodes named exactly like a word of the query (two bytes or more, case kept), four a word by id."""
    spark = store.nodes.sparkSession
    words = spark.createDataFrame([(query or "",)], "q string").select(F.explode(F.split("q", r"[^\p{IsAlphabetic}\p{N}_]+", -1)).alias("name")).where(F.octet_length("name") >= 2).distinct()
    hit = store.nodes.select("name", "id").join(F.broadcast(words), "name", "left_semi")
    least = hit.groupBy("name").agg(F.slice(F.sort_array(F.collect_set("id")), 1, NAMES_A_TERM).alias("ids"))
    return least.select(F.explode("ids").alias("id")).distinct()


def chunk_priors(store: Store, chunks: DataFrame, query: str | None = None) -> DataFrame:
    """(id, prior) of chunks at a path of the graph: the most of rank + half the betweenness over the path's nodes.

    Betweenness isn't normalised, so it outweighs the rank on large graphs. Only priors above 0 come back."""
    seeds = seeds_of(store, query)
    rank = walk.pagerank(store.nodes, store.edges, seeds if seeds.limit(1).count() else None)
    both = rank.join(between.betweenness(store.nodes, store.edges).withColumnRenamed("score", "bridge"), "id", "left")
    per_path = store.nodes.select("id", "path").join(both, "id").groupBy("path").agg(F.max(F.col("score") + BRIDGE_SHARE * F.coalesce("bridge", F.lit(0.0))).alias("prior"))
    return chunks.where("path is not null").select("id", "path").join(per_path, "path").where("prior > 0").select("id", "prior")


def tag_communities(store: Store, chunks: DataFrame) -> DataFrame:
    """chunks with community filled by the most frequent one at their path (ties: the least); given labels stay."""
    found = community.louvain(store.nodes, store.edges)
    counts = store.nodes.select("id", "path").join(found, "id").groupBy("path", "community").agg(F.count("*").alias("n"))
    mode = counts.groupBy("path").agg(F.max_by("community", F.struct("n", -F.col("community"))).alias("_label"))
    return chunks.join(mode, "path", "left").withColumn("community", F.coalesce("community", "_label")).select(*chunks.columns)


def impact(store: Store, paths: list[str], depth: int = 2, strategy: str = "bfs", reachable_only: bool = False) -> DataFrame:
    """(path): files affected by changes at paths, by breadth-first radius, random walk or a Steiner subgraph. The last
    has the nodes at the changed paths as terminals, which come to the driver."""
    seeds = store.nodes.where(F.col("path").isin(*paths)).select("id") if paths else store.nodes.select("id").limit(0)
    if strategy == "bfs":
        ids = traverse.levels(store.edges, seeds, False, DEPENDENCY_KINDS, depth).select("id")
    elif strategy == "rwr":
        ids = walk.top(walk.random_walk(store.nodes, store.edges, seeds), walk.TOP_RWR).where("score > 0").select("id")
    elif strategy == "steiner":
        found, _ = traverse.steiner(store.nodes, store.edges, [r.id for r in seeds.orderBy("id").collect()])
        ids = store.nodes.sparkSession.createDataFrame([(i,) for i in found], "id long")
    else:
        raise ValueError("strategy must be bfs, rwr or steiner")
    if reachable_only:
        ids = traverse.prune_unreachable(store.edges, ids, seeds)
    return traverse.affected_paths(store.nodes, ids)


def listing(store: Store, scores: DataFrame, k: int, digits: int) -> DataFrame:
    """(id, name, path, score): the k best scores with their nodes, rounded."""
    best = walk.top(scores, k)
    return best.join(store.nodes.select("id", "name", "path"), "id").select("id", "name", "path", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "id")
