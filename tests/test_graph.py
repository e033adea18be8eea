import collections
import tracemalloc

import numpy as np
import pytest

from loomspark.model import NODE
from loomspark.operators.graph import betweenness, build, community, priors, store, traverse, walk
from loomspark.scratch import global_rank, ready


def graph(spark, n, links, kind="calls"):
    nodes = spark.createDataFrame([(i, "function", f"n{i}", f"q{i}", f"f{i % 3}", "python", i, i, f"def n{i}()", 0) for i in range(1, n + 1)], NODE)
    edges = spark.createDataFrame([(a, b, kind, 1.0) for a, b in links], "src long, dst long, kind string, confidence double")
    return nodes, edges


def got(df):
    return {r[0]: r[1] for r in df.collect()}


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_global_rank(spark):
    d = spark.range(1000).selectExpr("id as pos", "id % 7 as s")
    r = {x.pos: x.k for x in global_rank(d, [d.s.desc(), d.pos.asc()], "k").collect()}
    want = sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert [r[i] for i in want] == list(range(1, 1001))


def test_pagerank_and_walks(spark, monkeypatch):
    nodes, edges = graph(spark, 5, [(1, 2), (2, 3), (3, 1), (3, 4)])
    plain, mine = got(walk.pagerank(nodes, edges)), got(walk.pagerank(nodes, edges, seeds(spark, 1)))
    assert mine[1] > plain[1] and sum(plain.values()) == pytest.approx(1.0)
    r = got(walk.random_walk(nodes, edges, seeds(spark, 1, 1)))
    assert sum(r.values()) < 1 and r[1] > r[2] > r[5]
    assert got(walk.pagerank(nodes, edges, seeds(spark, 99))) == pytest.approx(plain)
    monkeypatch.setattr(walk, "local_arrays", lambda df: None)  # the joins give what the arrays give
    assert got(walk.pagerank(nodes, edges)) == pytest.approx(plain, abs=1e-6)


def brandes(n, links):
    adj = collections.defaultdict(set)
    for a, b in links:
        adj[a].add(b), adj[b].add(a)
    out = dict.fromkeys(range(1, n + 1), 0.0)
    for s in range(1, n + 1):
        dist, sigma, order, queue = {s: 0}, collections.Counter({s: 1}), [], collections.deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = collections.Counter()
        for w in reversed(order):
            for v in adj[w]:
                if dist.get(v, -1) == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    return out


def test_betweenness_both_ways(spark, monkeypatch):
    links = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (6, 7), (5, 7)]
    nodes, edges = graph(spark, 8, links)
    places = betweenness.pivot_places(8)
    arrays = got(betweenness.betweenness(nodes, edges))
    if len(places) == 8:
        assert arrays == pytest.approx({k: v / 2 for k, v in brandes(8, links).items()})
    assert arrays[4] > 1.5 * arrays[1]
    monkeypatch.setattr(betweenness, "local_arrays", lambda df: None)
    assert got(betweenness.betweenness(nodes, edges)) == pytest.approx(arrays)


def test_betweenness_writes_no_table_a_ring(spark, monkeypatch):
    nodes, edges = graph(spark, 30, [(i, i + 1) for i in range(1, 30)])
    arrays = got(betweenness.betweenness(nodes, edges, 20))
    written = []
    monkeypatch.setattr(betweenness, "local_arrays", lambda df: None)
    monkeypatch.setattr(betweenness, "materialize", lambda df, name="step", f=betweenness.materialize: written.append(name) or f(df, name))
    assert got(betweenness.betweenness(nodes, edges, 20)) == pytest.approx(arrays)
    assert len(written) <= 6


def test_steiner_links_the_graph_once(spark, monkeypatch):
    nodes, edges = graph(spark, 12, [(i, i + 1) for i in range(1, 12)])
    written = []
    monkeypatch.setattr(traverse, "materialize", lambda df, name="step", f=traverse.materialize: written.append(name) or f(df, name))
    assert traverse.steiner(nodes, edges, [1, 12])[0] == list(range(1, 13))
    assert written.count("pairs") == 1


def test_local_moves_hold_few_bytes_a_link():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2000, 200_000), rng.integers(2000, 30_000, 200_000)
    a, b = np.concatenate([a, b]) + 10**9, np.concatenate([b, a]) + 10**9
    tracemalloc.start()
    found = community.local_moves(a, b, np.full(len(a), 0.7), 140_000.0, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == len(np.unique(a)) and peak < 70 * len(a)


def test_communities(spark):
    nodes, edges = graph(spark, 7, [(1, 2), (2, 3), (3, 1), (4, 5), (5, 6), (6, 4), (3, 4)])
    c = got(community.louvain(nodes, edges))
    assert c[1] == c[2] == c[3] == 0 and c[4] == c[5] == c[6] == 1 and c[7] == 2
    assert community.modularity(edges, community.louvain(nodes, edges)) > 0.2
    lone = got(community.louvain(*graph(spark, 2, [(1, 1)])))
    assert lone == {1: 0, 2: 1}


def test_impact_and_reachability(spark):
    nodes, edges = graph(spark, 4, [(1, 2), (2, 3)])
    edges = edges.unionByName(edges.limit(0)).unionByName(spark.createDataFrame([(4, 3, "contains", 1.0)], edges.schema))
    assert got(traverse.impact_radius(nodes.where("id = 3"), edges, ["f0"], 1)) == {3: 0, 2: 1}
    assert sorted(r.id for r in traverse.reachable(edges, seeds(spark, 1, 77)).collect()) == [1, 2, 3, 77]
    assert sorted(r.id for r in traverse.reverse_reachable(edges, seeds(spark, 3)).collect()) == [1, 2, 3]
    assert [r.id for r in traverse.prune_unreachable(edges, seeds(spark, 3, 4), seeds(spark, 1)).collect()] == [3]
    assert traverse.file_skeleton(nodes, "f0").first()[0] == "def n3();\n"


def test_steiner(spark):
    nodes, edges = graph(spark, 6, [(1, 2), (1, 3), (1, 4), (1, 5)])
    found, links = traverse.steiner(nodes, edges, [2, 3, 4])
    assert found == [1, 2, 3, 4] and len(links) == 3
    assert traverse.steiner(nodes, edges, [2]) == ([2], []) and traverse.steiner(nodes, edges, [2, 6]) == ([2, 6], []) and traverse.steiner(nodes, edges, []) == ([], [])


def sources(spark, **files):
    return spark.createDataFrame([(p.replace("_", "/") + ".py", "python", c) for p, c in files.items()], "path string, language string, content string")


def test_incremental_index(spark, tmp_path):
    first = sources(spark, a="def f():\n    return g()\n", b="def g():\n    pass\n", c="import os\n")
    s, r = build.build(first)
    assert (r.scanned, r.reparsed, r.skipped) == (3, 3, 0) and s.stats()[2] == 3
    name = {x.id: x.name for x in s.nodes.collect()}
    assert {(name[e.src], name[e.dst], e.kind) for e in s.edges.collect()} == {("a.py", "f", "contains"), ("b.py", "g", "contains"), ("f", "g", "calls"), ("c.py", "import os", "imports")}
    s = s.save(str(tmp_path / "g"))
    ids = {x.qualified: x.id for x in s.nodes.collect()}
    again, r = build.update(store.Store.open(spark, str(tmp_path / "g")), sources(spark, a="def f():\n    return g()\n", b="def g():\n    return 1\n\ndef h():\n    f()\n"))
    assert (r.reparsed, r.skipped) == (1, 1)
    now = {x.qualified: x.id for x in again.nodes.collect()}
    assert now["b.py::g"] == ids["b.py::g"] and "c.py::import::import os" not in now and len(set(now.values())) == len(now)
    name = {v: k for k, v in now.items()}
    # edges from an unchanged file into a changed one are gone until it changes too
    assert {(name[e.src], name[e.dst]) for e in again.edges.where("kind = 'calls'").collect()} == {("b.py::h", "a.py::f")}
    assert store.Store.open(spark, str(tmp_path / "none")).stats() == (0, 0, 0)


def test_priors_and_tags(spark):
    g, _ = build.build(sources(spark, a="def f():\n    return g()\n", b="def g():\n    pass\n"))
    c = spark.createDataFrame([("x", "b.py", None), ("y", "zzz", None), ("z", "a.py", 9)], "id string, path string, community int")
    p = got(priors.chunk_priors(g, c, "g of"))
    assert set(p) == {"x", "z"} and p["x"] > 0
    t = {r.id: r.community for r in priors.tag_communities(g, c).collect()}
    assert t["z"] == 9 and t["y"] is None and t["x"] is not None
    assert [r.path for r in priors.impact(g, ["b.py"], 2).collect()] == ["a.py", "b.py"]
    assert np.isin(["a.py"], [r.path for r in priors.impact(g, ["a.py"], strategy="rwr").collect()]).all()


def test_partitions_are_kept_small(spark):
    ready(spark)
    assert [spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")] == ["16m", "32m"]
