"""The registered queries of the engine's own operators against their DuckDB forms, on the smallest tables."""

import duckdb
import pytest

from loomspark.plans import catalog

FAST = ["tokenize", "lines_shingles", "strip_regex", "exact_dedup", "simhash_pairs", "boilerplate_collapse", "rank_final", "rank_feedback", "rm3_query", "budget_greedy", "impact_bfs", "personalized_pagerank", "build_edges", "manifest_diff", "upsert_nodes", "usage_by_query", "debounce_sessions",
        "display_format", "bundle", "request_files", "selection_requests", "tree_scan", "resolve_imports", "usage_log", "skeleton_apply", "store_snapshot", "point_lookups", "watch_stream", "pagerank_joins"]


def rows(names, found):
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(clean(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", FAST)
def test_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem", "events", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, sf_dir)
    want = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
