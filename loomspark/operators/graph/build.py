"""From source files to graph tables, in full or by what changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.udfs import symbols_of
from loomspark.model import CONFIDENCE
from loomspark.operators.graph.store import Store, delete_files, upsert_edges, upsert_files, upsert_nodes
from loomspark.scratch import global_rank, materialize


@dataclass(frozen=True)
class BuildReport:
    scanned: int
    reparsed: int
    skipped: int
    nodes_written: int
    edges_written: int


def manifest_diff(files: DataFrame, current: DataFrame) -> DataFrame:
    """(path, status): new, changed, deleted or same, of current (path, sha256) against the manifest."""
    old = files.select("path", F.col("sha256").alias("_old"))
    both = current.select("path", F.col("sha256").alias("_new")).join(old, "path", "full_outer")
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return both.select("path", status.alias("status"))


def _edges(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the parsed symbols among all nodes. Names resolve to the node of least qualified name, so the result
    depends neither on the order of files nor on forward references."""
    own = nodes.select(F.col("qualified").alias("_q"), F.col("id").alias("_id"))
    rows = symbols.join(own, F.col("qualified") == F.col("_q")).select(F.col("_id").alias("me"), "kind", "parent", "calls", "bases")
    up = rows.where("parent is not null").join(own, F.col("parent") == F.col("_q"))
    held = up.where("kind <> 'import'").select(F.col("_id").alias("src"), F.col("me").alias("dst"), F.lit("contains").alias("kind"))
    imports = up.where("kind = 'import'").select(F.col("_id").alias("src"), F.col("me").alias("dst"), F.lit("imports").alias("kind"))
    first = nodes.groupBy("name").agg(F.min_by("id", "qualified").alias("dst"))
    called = rows.select("me", F.explode(F.array_distinct("calls")).alias("name"), F.lit("calls").alias("kind"))
    based = rows.select("me", F.explode(F.array_distinct("bases")).alias("name"), F.lit("inherits").alias("kind"))
    named = called.unionByName(based).join(first, "name").select(F.col("me").alias("src"), "dst", "kind")
    out = held.unionByName(imports).unionByName(named).distinct()
    weight = F.create_map(*[x for k, v in CONFIDENCE.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("confidence", weight[F.col("kind")])


def update(store: Store, sources: DataFrame, paths: DataFrame | None = None) -> tuple[Store, BuildReport]:
    """The graph after indexing sources (path, language, content), and what was done.

    Files whose digest the manifest has are skipped, changed ones are deleted and parsed anew, and manifest rows
    without a source go, all of them or only those at paths (path). New nodes are numbered in order of path, line and
    name behind the largest id so far; known ones keep theirs."""
    src = materialize(sources.withColumn("sha256", F.sha2("content", 256)), "sources")
    if paths is not None:
        src = src.join(paths.select("path").distinct(), "path", "left_semi")
        known = store.files.join(paths.select("path").distinct(), "path", "left_semi")
    else:
        known = store.files
    diff = materialize(manifest_diff(known, src), "diff")
    counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    stale = diff.where("status in ('changed', 'deleted')").select("path")
    ids = store.nodes.select("qualified", F.col("id").alias("_was"))
    nodes, edges, files = delete_files(store.nodes, store.edges, store.files, stale)
    fresh = src.join(diff.where("status in ('new', 'changed')").select("path"), "path", "left_semi")
    symbols = materialize(symbols_of(fresh).dropDuplicates(["qualified"]), "symbols")
    top = store.nodes.agg(F.max("id")).first()[0] or 0
    ranked = global_rank(symbols.join(ids, "qualified", "left"), [F.asc("path"), F.asc("start_line"), F.asc("qualified")], "_n")
    new = ranked.withColumn("id", F.coalesce("_was", F.col("_n") + top)).select(*store.nodes.columns)
    nodes = materialize(upsert_nodes(nodes, new), "nodes")
    found = materialize(_edges(symbols, nodes), "edges")
    edges = upsert_edges(edges, found)
    files = upsert_files(files, fresh.select("path", "sha256", "language", F.unix_timestamp().cast("long").alias("last_indexed")))
    report = BuildReport(src.count(), counts.get("new", 0) + counts.get("changed", 0), counts.get("same", 0), symbols.count(), found.count())
    return Store(nodes, materialize(edges, "edges"), materialize(files, "files")), report


def build(sources: DataFrame) -> tuple[Store, BuildReport]:
    return update(Store.empty(sources.sparkSession), sources)
