"""Command line over the API: python -m loomspark.cli COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark import __version__
from loomspark.model import DEPENDENCY_KINDS, STRATEGIES, Config
from loomspark.operators import pipeline, usage
from loomspark.operators.graph import betweenness, build, community, priors, traverse, walk
from loomspark.operators.graph.store import Store
from loomspark.model import USAGE
from loomspark.sources import files, requests, usage_log

STEINER_NAMES = 8


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspark")
    p.add_argument("--root", default=".", help="source tree")
    p.add_argument("--store", help="graph snapshots (default: ROOT/.loomspark)")
    p.add_argument("--usage", help="usage log (default: STORE/usage)")
    sub = p.add_subparsers(dest="command", required=True)
    o = sub.add_parser("optimize")
    o.add_argument("--input"), o.add_argument("--output"), o.add_argument("--query")
    o.add_argument("--max-tokens", type=int, default=8000), o.add_argument("--strategy", choices=STRATEGIES, default="auto")
    for flag in ("pretty", "rm3", "graph", "community-budget", "no-cache-order"):
        o.add_argument(f"--{flag}", action="store_true")
    for name in ("build", "stats", "serve", "version"):
        sub.add_parser(name)
    sub.add_parser("update").add_argument("paths", nargs="*")
    i = sub.add_parser("impact")
    i.add_argument("paths", nargs="+"), i.add_argument("--depth", type=int, default=2)
    i.add_argument("--strategy", choices=("bfs", "rwr", "steiner"), default="bfs"), i.add_argument("--reachable-only", action="store_true")
    sub.add_parser("skeleton").add_argument("path")
    sub.add_parser("watch").add_argument("events")
    s = sub.add_parser("savings")
    s.add_argument("--project"), s.add_argument("--top", type=int, default=10)
    for name in ("rwr", "steiner", "reachable"):
        q = sub.add_parser(name)
        q.add_argument("names", nargs="+"), q.add_argument("--top", type=int, default=20), q.add_argument("--reverse", action="store_true")
    for name in ("communities", "bridges"):
        sub.add_parser(name).add_argument("--top", type=int, default=20)
    return p


def _named(store: Store, names: list[str], each: int) -> DataFrame:
    rows = store.nodes.where(F.col("name").isin(*names))
    return rows.groupBy("name").agg(F.slice(F.sort_array(F.collect_set("id")), 1, each).alias("i")).select(F.explode("i").alias("id")).distinct()


def run(spark: SparkSession, argv: list[str], stdin=sys.stdin, out=sys.stdout) -> int:
    a = parser().parse_args(argv)
    store_dir = a.store or f"{a.root.rstrip('/')}/.loomspark"
    log = a.usage or f"{store_dir}/usage"
    say = lambda x: print(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False), file=out)
    show = lambda df: [say(r.asDict()) for r in df.collect()]
    if a.command == "version":
        say(__version__)
        return 0
    if a.command == "savings":
        rows = usage.of_project(usage_log.read_usage(spark, log), a.project)
        show(usage.totals(rows))
        show(usage.by_query(rows, a.top))
        return 0
    store = Store.open(spark, store_dir)
    if a.command == "optimize":
        chunks, query = requests.read_request(spark, a.input) if a.input else requests.parse_request(spark, stdin.read())
        query = a.query if a.query is not None else query
        config = Config(max_tokens=a.max_tokens, strategy=a.strategy, rm3=a.rm3, community_budget=a.community_budget, cache_order=not a.no_cache_order)
        prior = None
        if a.graph:
            prior = priors.chunk_priors(store, chunks, query)
            chunks = priors.tag_communities(store, chunks) if a.community_budget else chunks
        got = pipeline.optimize(chunks, query, config, prior)
        text = requests.result_json(got, a.pretty)
        if a.output:
            with open(a.output, "w") as f:
                f.write(text + "\n")
        else:
            say(text)
        record = [(int(time.time()), got.original_tokens, got.final_tokens, got.tokens_saved, got.elapsed_ms, query, chunks.count(), got.chunks.count(), "cli", a.root)]
        usage_log.append_usage(spark.createDataFrame(record, USAGE), log)
    elif a.command in ("build", "update"):
        listed = None
        if a.command == "update":
            listed = files.path_list(spark, a.paths or stdin.read().splitlines())
        new, report = build.update(store, files.scan(spark, a.root, [".loomspark/"]), listed)
        new.save(store_dir)
        say(vars(report))
    elif a.command == "stats":
        say(dict(zip(("nodes", "edges", "files"), store.stats())))
    elif a.command == "impact":
        show(priors.impact(store, a.paths, a.depth, a.strategy, a.reachable_only))
    elif a.command == "skeleton":
        say(traverse.file_skeleton(store.nodes, a.path).first()[0])
    elif a.command == "watch":
        from loomspark.streaming import watch

        watch.index_stream(watch.read_events(spark, a.events), store_dir, a.root, f"{store_dir}/checkpoint", [".loomspark/"]).awaitTermination()
    elif a.command == "serve":
        from loomspark.streaming.rpc import Server

        for reply in Server(spark, store_dir, a.root).serve(stdin):
            say(reply)
    elif a.command == "rwr":
        show(priors.listing(store, walk.random_walk(store.nodes, store.edges, _named(store, a.names, priors.NAMES_A_TERM)), a.top, 6))
    elif a.command == "bridges":
        show(priors.listing(store, betweenness.betweenness(store.nodes, store.edges), a.top, 4))
    elif a.command == "communities":
        show(community.louvain(store.nodes, store.edges).groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(a.top))
    elif a.command == "steiner":
        ids = [r.id for r in _named(store, a.names, STEINER_NAMES).orderBy("id").collect()]
        found, links = traverse.steiner(store.nodes, store.edges, ids)
        say({"nodes": found, "edges": links})
    elif a.command == "reachable":
        roots = _named(store, a.names, STEINER_NAMES)
        ids = traverse.levels(store.edges, roots, not a.reverse, DEPENDENCY_KINDS).select("id")
        show(store.nodes.join(ids, "id", "left_semi").select("id", "name", "path").orderBy("id").limit(a.top))
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("loomspark").getOrCreate(), sys.argv[1:]))
