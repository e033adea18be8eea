"""Reachability, impact radius and shortest-path subgraphs by joining frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.model import DEPENDENCY_KINDS
from loomspark.scratch import is_empty, materialize, small


def levels(edges: DataFrame, seeds: DataFrame, forward: bool = True, kinds: tuple[str, ...] | None = DEPENDENCY_KINDS, depth: int | None = None) -> DataFrame:
    """(id, depth): seeds (id) at depth 0 and all they reach, breadth first. Seeds need not be in the graph.

    A round joins the frontier with the edges and drops what was seen; only the frontier is shuffled anew."""
    e = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    e = e.select(F.col("src" if forward else "dst").alias("_from"), F.col("dst" if forward else "src").alias("_to"))
    frontier = materialize(seeds.select("id").where("id is not null").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen, d = frontier, 0
    while depth is None or d < depth:
        d += 1
        step = e.join(small(frontier.select(F.col("id").alias("_from"))), "_from").select(F.col("_to").alias("id")).distinct()
        frontier = materialize(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        if is_empty(frontier):
            break
        seen = seen.unionByName(frontier)
    return seen


def impact_radius(nodes: DataFrame, edges: DataFrame, paths: list[str], depth: int = 2) -> DataFrame:
    """(id, depth): what depends on the files at paths, over calls, imports and inheritance backwards."""
    return levels(edges, nodes.where(F.col("path").isin(*paths)) if paths else nodes.limit(0), forward=False, depth=depth)


def reachable(edges: DataFrame, roots: DataFrame, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> DataFrame:
    return levels(edges, roots, True, kinds).select("id")


def reverse_reachable(edges: DataFrame, roots: DataFrame, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> DataFrame:
    return levels(edges, roots, False, kinds).select("id")


def prune_unreachable(edges: DataFrame, pool: DataFrame, roots: DataFrame, kinds: tuple[str, ...] = DEPENDENCY_KINDS) -> DataFrame:
    """The rows of pool (id) that roots reach."""
    return pool.join(reachable(edges, roots, kinds), "id", "left_semi")


def affected_paths(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.select("id"), "id", "left_semi").select("path").distinct().orderBy("path")


def file_skeleton(nodes: DataFrame, path: str) -> DataFrame:
    """One row (skeleton): the signatures of a file's nodes by line, each closed by a semicolon."""
    sig = F.trim("signature")
    rows = nodes.where((F.col("path") == path) & (F.col("kind") != "file") & F.col("signature").isNotNull())
    rows = rows.select("start_line", "id", F.when(sig.endswith(";"), sig).otherwise(F.concat(sig, F.lit(";"))).alias("s"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start_line", "id", "s"))), lambda x: F.concat(x["s"], F.lit("\n")))
    return rows.agg(F.array_join(parts, "").alias("skeleton"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): each pair of different linked nodes, both ways, once."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def shortest_paths(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, dist, pred): breadth-first trees from each of sources (source) at once; pred is the least one."""
    frontier = materialize(sources.select("source", F.col("source").alias("id"), F.lit(0).alias("dist"), F.lit(None).cast("long").alias("pred")).distinct(), "tree")
    seen, d = frontier, 0
    while True:
        d += 1
        step = pairs.join(small(frontier.select("source", F.col("id").alias("a"))), "a").groupBy("source", F.col("b").alias("id")).agg(F.min("a").alias("pred"))
        frontier = materialize(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(d).alias("dist"), "pred"), "tree")
        if is_empty(frontier):
            return seen
        seen = seen.unionByName(frontier)


def steiner(nodes: DataFrame, edges: DataFrame, terminals: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """(sorted nodes, sorted edges) of a small subgraph that links the terminals.

    Shortest-path trees from all terminals are DataFrames; to the driver come the distances among the terminals and
    the paths of the spanning tree, which follow the number of terminals. Terminals that can't be linked come back
    alone; unknown ones are dropped; none at all gives nothing."""
    spark = nodes.sparkSession
    wanted = spark.createDataFrame([(int(t),) for t in dict.fromkeys(terminals)], "id long")
    known = {r.id for r in nodes.select("id").join(F.broadcast(wanted), "id", "left_semi").collect()}
    terms = [t for t in terminals if t in known]
    if len(terms) < 2:
        return sorted(terms), []
    sources = spark.createDataFrame([(t,) for t in dict.fromkeys(terms)], "source long")
    tree = materialize(shortest_paths(materialize(undirected(edges), "pairs"), sources), "trees")
    ends = sources.withColumnRenamed("source", "id")
    dist = {(r.source, r.id): r.dist for r in tree.join(F.broadcast(ends), "id", "left_semi").collect()}
    linked, links = [0], []
    while len(links) < len(terms) - 1:
        options = [(dist[terms[i], terms[j]], i, j) for i in sorted(linked) for j in range(len(terms)) if j not in linked and (terms[i], terms[j]) in dist]
        if not options:
            break
        _, i, j = min(options)
        links.append((terms[i], terms[j]))
        linked.append(j)
    found, steps = set(terms), set()
    walk = [(a, b) for a, b in links if a != b]
    while walk:
        at = spark.createDataFrame(sorted(set(walk)), "source long, id long")
        pred = {(r.source, r.id): r.pred for r in tree.join(F.broadcast(at), ["source", "id"], "left_semi").collect()}
        nxt = []
        for a, b in walk:
            p = pred[a, b]
            found |= {p, b}
            steps.add((p, b))
            if p != a:
                nxt.append((a, p))
        walk = nxt
    while True:
        degree: dict[int, int] = {}
        for a, b in steps:
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        leaves = {v for v in found if v not in terms and degree.get(v, 0) <= 1}
        if not leaves:
            return sorted(found), sorted(steps)
        found -= leaves
        steps = {(a, b) for a, b in steps if a not in leaves and b not in leaves}
