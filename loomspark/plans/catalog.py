"""The registered queries of the engine's own operators; oracles.py has their DuckDB forms."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.udfs import content_chunks, skeleton_code, strip_raw, symbols_of
from loomspark.model import CHUNK, Config
from loomspark.operators import budget, compress, dedup, pipeline, ranking
from loomspark.operators import usage as reports
from loomspark.operators.graph import betweenness, build, community, priors, store, traverse, walk
from loomspark.plans import oracles, views
from loomspark.plans.views import chunks, graph, table
from loomspark.scratch import materialize, scratch_dir
from loomspark.sources import files, requests
from loomspark.sources import usage_log as usage_rows
from loomspark.streaming import watch

QUERY = oracles.QUERY
ROUNDS = oracles.ROUNDS
FOLDER_TASKS = 96
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# ---------------------------------------------------------------- text


@query
def token_estimate(spark, sf):
    c = F.col("content")
    return chunks(spark, sf).select("pos", T.estimate_tokens(c).alias("tokens"), T.chars_for_tokens(T.estimate_tokens(c)).alias("chars"))


@query
def normalize_ws(spark, sf):
    return chunks(spark, sf).select("pos", F.md5(T.normalize_whitespace(F.col("content"))).alias("digest"))


@query
def tokenize(spark, sf):
    t = T.tokenize_words(F.col("content"))
    return chunks(spark, sf).select("pos", t.alias("t")).select("pos", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def line_fingerprint(spark, sf):
    return chunks(spark, sf).select("pos", T.line_set(F.col("content")).alias("s")).select("pos", F.size("s").cast("long").alias("n"), F.md5(F.array_join(F.array_sort(F.transform("s", lambda x: F.md5(x))), "")).alias("digest"))


@query
def lines_shingles(spark, sf):
    return chunks(spark, sf).select("pos", T.line_shingles(F.col("content")).alias("s")).select("pos", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("digest"))


@query
def language_detect(spark, sf):
    ends = ["rs", "TS", "tsx", "js", "mjs", "cjs", "py", "pyi", "json", "md", "markdown", "txt", ""]
    ext = F.element_at(F.array(*[F.lit(x) for x in ends]), (F.col("doc_id") % len(ends) + 1).cast("int"))
    path = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("dir/noext"), F.col("doc_id"))).otherwise(F.concat(F.lit("a/b."), F.col("doc_id"), F.lit("."), ext))
    d = table(spark, sf, "documents").select("doc_id", path.alias("path"))
    return d.select("doc_id", T.language_of_path(F.col("path")).alias("language"), F.array_join(T.line_comment_prefixes(T.language_of_path(F.col("path"))), ",").alias("prefixes"))


def _noisy(spark, sf):
    """Texts with comments and logs behind them, in four languages."""
    tail = "\n/* a\nb */ y  = 2; # c // d\n  console.log(1);\nprintln!(2);\nprint(3)\n'''doc\nx''' z\n"
    lang = F.element_at(F.array(*[F.lit(x) for x in ("rust", "typescript", "python", "json")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", lang.alias("language"), F.concat(F.coalesce("text", F.lit("")), F.lit(tail)).alias("content"))


@query
def strip_regex(spark, sf):
    c, lang = F.col("content"), F.col("language")
    return _noisy(spark, sf).select("doc_id", F.md5(T.strip_logs(T.strip_comments(c, lang), lang)).alias("digest"))


@query
def strip_post(spark, sf):
    return _noisy(spark, sf).select("doc_id", F.md5(T.tidy_lines(F.col("content"))).alias("digest"))


@query
def strip_ast(spark, sf):
    got = strip_raw(F.col("content"), F.col("language"))
    return views.code_files(spark, sf).select("path", F.regexp_count(got, F.lit("#")).cast("long").alias("hashes"), F.regexp_count(got, F.lit(r"print\(")).cast("long").alias("prints"), F.length(got).cast("long").alias("chars"))


@query
def skeleton(spark, sf):
    return views.code_files(spark, sf).select("path", F.md5(skeleton_code(F.col("content"), F.col("language"))).alias("digest"))


@query
def cdc_chunks(spark, sf):
    return chunks(spark, sf).select("pos", F.explode(content_chunks(F.col("content"))).alias("s")).select("pos", "s.start", "s.end")


@query
def display_format(spark, sf):
    n = F.col("in_tokens") * 37
    return views.usage(spark, sf).select("ts", T.humanize(n).alias("size"), T.humanize_ms(F.col("elapsed_ms") * 90).alias("time"), T.ellipsis(F.col("query"), 5).alias("short"), T.bar(F.col("elapsed_ms") / 50, 10).alias("bar"))


# ---------------------------------------------------------------- de-duplication


@query
def exact_dedup(spark, sf):
    return dedup.exact_dedup(chunks(spark, sf)).select("pos")


def _hex(c):
    return F.lower(F.lpad(F.hex(c), 16, "0"))


@query
def simhash_fp(spark, sf):
    return dedup.simhash(chunks(spark, sf)).select("pos", _hex("fp").alias("fp"))


@query
def simhash_pairs(spark, sf):
    prints = materialize(dedup.simhash(dedup.exact_dedup(chunks(spark, sf))), "prints")
    firsts = dedup._first_of_equal(prints.where("fp <> 0"), "fp")
    return dedup.simhash_pairs(firsts).select("a", "b", F.col("distance").cast("long").alias("distance"), F.round(F.lit(1.0) - F.col("distance") / 64, 6).alias("similarity"))


@query
def dedup_members(spark, sf):
    """Class membership of every chunk: with it the pairs among first rows give the links of all rows."""
    return dedup.members(chunks(spark, sf))


@query
def minhash_sig(spark, sf):
    return dedup.minhash(chunks(spark, sf)).select("pos", F.md5(F.array_join(F.transform("sig", lambda x: x.cast("string")), ",")).alias("digest"))


def _word_lines(spark, sf):
    """Exact-distinct chunks with a line for each word, so that line shingles are word shingles."""
    return dedup.exact_dedup(chunks(spark, sf)).withColumn("content", F.replace("content", F.lit(" "), F.lit("\n")))


@query
def lsh_candidates(spark, sf):
    return dedup.lsh_pairs(dedup.minhash(_word_lines(spark, sf)), 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def line_jaccard_pairs(spark, sf):
    return dedup.line_jaccard_pairs(dedup.exact_dedup(chunks(spark, sf)), 0.5).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def simhash_dedup(spark, sf):
    return dedup.simhash_dedup(materialize(dedup.exact_dedup(chunks(spark, sf)), "exact")).select("pos")


@query
def lsh_dedup(spark, sf):
    return dedup.lsh_dedup(materialize(_word_lines(spark, sf), "exact"), 0.5).select("pos")


@query
def pairwise_dedup(spark, sf):
    return dedup.jaccard_dedup(materialize(dedup.exact_dedup(chunks(spark, sf)), "exact"), 0.5).select("pos")


@query
def dedup_cascade(spark, sf):
    return dedup.dedup(chunks(spark, sf))[0].select("pos")


# ---------------------------------------------------------------- compression


@query
def strip_chunks(spark, sf):
    return compress.strip_chunks(chunks(spark, sf)).select("pos", F.md5("content").alias("digest"))


@query
def boilerplate_collapse(spark, sf):
    return compress.collapse_boilerplate(chunks(spark, sf)).select("pos", F.md5("content").alias("digest"))


@query
def frequent_lines(spark, sf):
    return compress.frequent_lines(chunks(spark, sf)).select("key", F.col("times").cast("long").alias("times"), F.col("first.pos").alias("first_pos"), F.col("first.line").cast("long").alias("first_line"))


@query
def compress_stats(spark, sf):
    _, s = compress.compress(chunks(spark, sf))
    return spark.createDataFrame([tuple(vars(s).values())], "tokens_before long, tokens_after long, bytes_before long, bytes_after long, chunks_touched long")


@query
def line_sketch(spark, sf):
    return compress.line_sketch(chunks(spark, sf)).select("total")


# ---------------------------------------------------------------- ranking


@query
def bm25(spark, sf):
    c = chunks(spark, sf)
    return ranking.bm25(ranking.Corpus(c), ranking.query_terms(spark, QUERY)).select("pos", T.round_binary(F.col("score"), 6).alias("score"))


@query
def density(spark, sf):
    return ranking.density(ranking.Corpus(chunks(spark, sf))).select("pos", T.round_binary(F.col("score"), 6).alias("score"))


@query
def rm3_terms(spark, sf):
    corpus = ranking.Corpus(chunks(spark, sf))
    return ranking.feedback_terms(corpus, ranking.query_terms(spark, QUERY)).select("t", T.round_binary(F.col("weight"), 6).alias("weight"))


@query
def rm3_query(spark, sf):
    return ranking.expand_raw_query(ranking.Corpus(chunks(spark, sf)), QUERY).select("t", "times")


@query
def rank_priors(spark, sf):
    c = chunks(spark, sf)
    return ranking.rank_from_priors(c, c.where("pos % 3 = 0").select("id", (F.col("pos") % 10 / 10).alias("prior"))).select("pos", F.col("rank").cast("long").alias("rank"))


@query
def rrf_rank(spark, sf):
    """Fused ranks of BM25 (weight 1.5) and density (0.7)."""
    corpus = ranking.Corpus(chunks(spark, sf))
    lists = [(ranking.rank_by_score(ranking.bm25(corpus, ranking.query_terms(spark, QUERY))), 1.5), (ranking.rank_by_score(ranking.density(corpus)), 0.7)]
    return ranking.rrf(lists).select("pos", T.round_binary(F.col("score"), 9).alias("score"))


@query
def rank_final(spark, sf):
    got = ranking.rank(chunks(spark, sf), QUERY)
    return got.select("pos", F.col("rank").cast("long").alias("rank"), T.round_binary(F.col("score"), 9).alias("score"))


@query
def rank_feedback(spark, sf):
    """With feedback terms in the query and priors for every third chunk."""
    c = chunks(spark, sf)
    prior = c.where("pos % 3 = 0").select("id", (F.col("pos") % 10 / 10).alias("prior"))
    got = ranking.rank(c, QUERY, prior, feedback=True)
    return got.select("pos", F.col("rank").cast("long").alias("rank"), T.round_binary(F.col("score"), 9).alias("score"))


@query
def rank_no_query(spark, sf):
    got = ranking.rank(chunks(spark, sf), "the of and")
    return got.select("pos", F.col("rank").cast("long").alias("rank"))


# ---------------------------------------------------------------- budget


def _ranked(spark, sf):
    return chunks(spark, sf).withColumn("rank", F.col("pos") + 1)


@query
def budget_greedy(spark, sf):
    return budget.select(_ranked(spark, sf), 4000, "greedy")[0].select("pos")


@query
def budget_knapsack(spark, sf):
    """A request for each 200 documents."""
    many = _ranked(spark, sf).withColumn("request_id", F.floor(F.col("pos") / 200)).withColumn("rank", F.col("pos") % 200 + 1)
    return budget.select_many(many, 3000, "knapsack_dp")[1].select("request_id", "kept", "dropped", "final_tokens", "strategy")


@query
def budget_mmr(spark, sf):
    many = _ranked(spark, sf).withColumn("request_id", F.floor(F.col("pos") / 200)).withColumn("rank", F.col("pos") % 200 + 1)
    return budget.select_many(many, 3000, "auto", communities=True)[1].select("request_id", "kept", "dropped", "final_tokens", "strategy")


@query
def cache_order(spark, sf):
    got = budget.cache_order(chunks(spark, sf).where("length(content) > 0"), "pos")
    from loomspark.scratch import global_rank

    key = T.stable_hash(F.when(F.col("id") == "", F.col("content")).otherwise(F.col("id")))
    return global_rank(got.select("id", "pos", key.alias("k")), [F.asc("k"), F.asc("id"), F.asc("pos")], "place").select("pos", F.col("place").cast("long").alias("place"))


@query
def optimize_stats(spark, sf):
    got = pipeline.optimize(chunks(spark, sf), QUERY, Config())
    return got.frame().select("original_tokens", "final_tokens", "tokens_saved", F.round("reduction_pct", 6).alias("reduction_pct"))


@query
def bundle(spark, sf):
    """A request for each 50 documents."""
    got = requests.bundle(chunks(spark, sf).withColumn("request_id", F.floor(F.col("pos") / 50)), by=["request_id"])
    return got.select("request_id", F.md5("bundle").alias("digest"), F.length("bundle").cast("long").alias("chars"))


# ---------------------------------------------------------------- graph


def _roots(spark, sf):
    return table(spark, sf, "supplier").where("s_suppkey % 10 = 3").select(F.col("s_suppkey").alias("id"))


@query
def impact_bfs(spark, sf):
    g = graph(spark, sf)
    return traverse.impact_radius(g.nodes, g.edges, ["p/3"], 2).select("id", F.col("depth").cast("long").alias("depth"))


@query
def impact_paths(spark, sf):
    return priors.impact(graph(spark, sf), ["p/3", "r/1"], 2)


@query
def reachable(spark, sf):
    return traverse.reachable(graph(spark, sf).edges, _roots(spark, sf))


@query
def reverse_reachable(spark, sf):
    roots = table(spark, sf, "region").where("r_regionkey = 2").select((F.col("r_regionkey") + views.REGION).alias("id"))
    return traverse.reverse_reachable(graph(spark, sf).edges, roots)


@query
def prune_unreachable(spark, sf):
    g = graph(spark, sf)
    return traverse.prune_unreachable(g.edges, g.nodes.where("path = 'p/4'").select("id"), _roots(spark, sf))


@query
def skeleton_for(spark, sf):
    return traverse.file_skeleton(graph(spark, sf).nodes, "n/3")


@query
def pagerank(spark, sf):
    g = graph(spark, sf)
    return walk.pagerank(g.nodes, g.edges, rounds=ROUNDS, tolerance=None).select("id", F.round("score", 9).alias("score"))


@query
def personalized_pagerank(spark, sf):
    g = graph(spark, sf)
    return walk.pagerank(g.nodes, g.edges, _roots(spark, sf), rounds=ROUNDS, tolerance=None).select("id", F.round("score", 9).alias("score"))


@query
def random_walk_restart(spark, sf):
    g = graph(spark, sf)
    seeds = _roots(spark, sf)
    return walk.random_walk(g.nodes, g.edges, seeds.unionByName(seeds.where("id % 20 = 3")), rounds=ROUNDS, tolerance=None).select("id", F.round("score", 9).alias("score"))


@query
def weighted_walk(spark, sf):
    g = graph(spark, sf)
    seeds = _roots(spark, sf).select("id", (F.col("id") % 7 + 1).cast("double").alias("weight"))
    return walk.weighted_walk(g.nodes, g.edges, seeds, rounds=ROUNDS, tolerance=None).select("id", F.round("score", 9).alias("score"))


@query
def pagerank_joins(spark, sf):
    """By the joins that larger graphs take."""
    g = graph(spark, sf)
    return walk.pagerank(g.nodes, g.edges, rounds=ROUNDS, tolerance=None, arrays=False).select("id", F.round("score", 9).alias("score"))


@query
def weighted_walk_joins(spark, sf):
    g = graph(spark, sf)
    seeds = _roots(spark, sf).select("id", (F.col("id") % 7 + 1).cast("double").alias("weight"))
    return walk.weighted_walk(g.nodes, g.edges, seeds, rounds=ROUNDS, tolerance=None, arrays=False).select("id", F.round("score", 9).alias("score"))


@query
def top_central(spark, sf):
    g = graph(spark, sf)
    return walk.top(walk.pagerank(g.nodes, g.edges), 20, g.nodes).select("id", F.round("score", 6).alias("score"))


@query
def communities(spark, sf):
    g = graph(spark, sf)
    return community.louvain(g.nodes, g.edges)


@query
def modularity(spark, sf):
    g = graph(spark, sf)
    labels = g.nodes.select("id", (F.col("id") % 5).cast("int").alias("community"))
    q = [community.modularity(g.edges, labels, textbook=t) for t in (False, True)]
    return spark.createDataFrame([tuple(round(x, 9) for x in q)], "adjacent double, textbook double")


@query
def bridges(spark, sf):
    g = graph(spark, sf)
    return betweenness.betweenness(g.nodes, g.edges).select("id", F.round("score", 6).alias("score"))


@query
def steiner_nodes(spark, sf):
    g = graph(spark, sf)
    found, _ = traverse.steiner(g.nodes, g.edges, [3, 7, views.PART + 11, views.REGION + 1])
    return spark.createDataFrame([(x,) for x in found], "id long")


@query
def graph_priors(spark, sf):
    g, _ = build.build(views.code_files(spark, sf))
    c = views.code_files(spark, sf).select(F.col("path").alias("id"), "path")
    return priors.chunk_priors(g, c, "f11 Base3").select("id", F.round("prior", 6).alias("prior"))


@query
def tag_communities(spark, sf):
    g, _ = build.build(views.code_files(spark, sf))
    c = views.code_files(spark, sf).select(F.col("path").alias("id"), "path", F.lit(None).cast("int").alias("community"))
    return priors.tag_communities(g, c).select("id", "community")


@query
def build_nodes(spark, sf):
    return build.build(views.code_files(spark, sf))[0].nodes.select("kind", "name", "qualified", "path", "start_line", "signature")


@query
def build_edges(spark, sf):
    g, _ = build.build(views.code_files(spark, sf))
    n = g.nodes.select("id", "qualified")
    e = g.edges.join(n.withColumnRenamed("id", "src").withColumnRenamed("qualified", "a"), "src").join(n.withColumnRenamed("id", "dst").withColumnRenamed("qualified", "b"), "dst")
    return e.select("a", "b", "kind", F.round("confidence", 6).alias("confidence"))


@query
def build_symbols(spark, sf):
    return symbols_of(views.code_files(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("calls")).cast("long").alias("calls"))


@query
def manifest_diff(spark, sf):
    part = table(spark, sf, "part")
    old = part.where("p_partkey % 5 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.sha2(F.col("p_partkey").cast("string"), 256).alias("sha256"))
    new = part.where("p_partkey % 7 <> 0").select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.sha2((F.col("p_partkey") + F.when(F.col("p_partkey") % 3 == 0, 1).otherwise(0)).cast("string"), 256).alias("sha256"))
    return build.manifest_diff(old, new)


@query
def upsert_nodes(spark, sf):
    g = graph(spark, sf)
    new = g.nodes.where("id % 4 = 1 and id < 1000000").withColumn("id", F.col("id") + 500).withColumn("name", F.lit("new")).withColumn("qualified", F.when(F.col("id") % 8 == 5, F.concat("qualified", F.lit("x"))).otherwise(F.col("qualified")))
    return store.upsert_nodes(g.nodes.where("id < 1000000"), new).select("id", "name", "qualified")


@query
def upsert_edges(spark, sf):
    g = graph(spark, sf)
    new = g.edges.where("src % 4 = 1").withColumn("confidence", F.lit(0.5)).withColumn("dst", F.when(F.col("dst") % 2 == 0, F.col("dst") + 10**10).otherwise(F.col("dst")))
    return store.upsert_edges(g.edges, new).select("src", "dst", "kind", "confidence")


@query
def delete_file(spark, sf):
    g = graph(spark, sf)
    n, e, _ = store.delete_files(g.nodes, g.edges, g.files, spark.createDataFrame([("p/3",), ("s/1",)], "path string"))
    return n.select("id", F.lit(None).cast("long").alias("dst")).unionByName(e.select(F.col("src").alias("id"), "dst"))


@query
def neighbours(spark, sf):
    return graph(spark, sf).neighbours(_roots(spark, sf)).select("src", "dst", "kind")


@query
def import_specs(spark, sf):
    return files.imports_of(views.code_files(spark, sf), relative_only=False).select("path", "spec")


# ---------------------------------------------------------------- sources and sinks


def _folder(spark, name: str) -> str:
    """A fresh folder among the scratch tables."""
    return f"{scratch_dir(spark)}/loomspark/{name}-{uuid.uuid4().hex}"


@query
def request_files(spark, sf):
    """A request file for each 50 documents, written and read back."""
    c = chunks(spark, sf).withColumn("skeleton_hint", F.col("pos") % 2 == 0).withColumn("request", F.floor(F.col("pos") / 50))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.struct("id", "path", "language", "content", "kind", "priority", "skeleton_hint").alias("c")))), lambda x: x["c"])
    folder = _folder(spark, "requests")
    c.groupBy("request").agg(F.to_json(F.struct(parts.alias("chunks"), F.concat(F.lit("q"), "request").alias("query"))).alias("value")).write.partitionBy("request").text(folder)
    got, asked = requests.read_requests(spark, folder + "/*/*.txt")
    got = got.join(asked, "request_id")
    return got.select("id", "pos", "query", "path", "language", "kind", "priority", "skeleton_hint", F.md5("content").alias("digest"))


@query
def result_lines(spark, sf):
    """All chunks as JSON lines, written and read back."""
    folder = _folder(spark, "results")
    requests.write_results(chunks(spark, sf), folder)
    back = spark.read.schema(CHUNK).json(folder)
    return back.select("id", "pos", "path", "kind", "priority", "community", F.md5("content").alias("digest"))


@query
def selection_requests(spark, sf):
    """The active file is region 1: as a whole, and with a selection."""
    active = table(spark, sf, "region").where("r_regionkey = 1").select(F.concat(F.lit("src/r"), "r_regionkey", F.lit(".ts")).alias("path"), F.col("r_name").alias("content"))
    both = requests.selection_request(active, None).unionByName(requests.selection_request(active, "let x"))
    return both.select("id", "path", "language", "content", "kind", "priority")


@query
def editor_languages(spark, sf):
    names = ["typescriptreact", "javascriptreact", "jsonc", "rust", "python", "markdown", "go", "json"]
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("doc_id") % len(names) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", files.editor_language(name).alias("language"))


@query
def path_list(spark, sf):
    """Nation names as lines, padded, with blank ones between."""
    names = [r.n_name for r in table(spark, sf, "nation").select("n_name").collect()]  # a fixed table of 25 rows
    return files.path_list(spark, [x for n in names for x in (f"  {n}\t", " ")])


@query
def tree_scan(spark, sf):
    """A file for each supplier, written, and read as a tree with ignore rules."""
    root = _folder(spark, "tree")
    rows = table(spark, sf, "supplier").select(F.col("s_name").alias("value"), F.col("s_suppkey").alias("dir"))
    # a folder a row: several tasks make and move them, each folder in one; AQE would go by their few bytes
    many = F.pmod(F.col("dir"), F.lit(FOLDER_TASKS)).cast("int")
    rows.repartition(FOLDER_TASKS, many).write.partitionBy("dir").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(root)
    got = files.scan(spark, root, ["# note", "dir=1*/", "!dir=11/", "_SUCCESS", "*.crc"], code_only=False)
    return got.select(F.regexp_extract("path", "dir=([0-9]+)/", 1).cast("long").alias("key"), "language", F.md5("content").alias("digest"))


@query
def resolve_imports(spark, sf):
    """Part k imports k + 1 in its folder, k + 2 through the folder above, and a folder's index."""
    k = F.col("p_partkey")
    part = table(spark, sf, "part").select(k)
    specs = F.array(F.concat(F.lit("./p"), k + 1), F.concat(F.lit("../a/./p"), k + 2), F.concat(F.lit("../b/x"), k))
    imports = part.select(F.concat(F.lit("a/p"), k, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), F.explode(specs).alias("spec"))
    own = part.select(F.concat(F.lit("a/p"), k, F.when(k % 3 == 0, ".tsx").otherwise(".ts")).alias("path"))
    index = part.where(k % 4 == 0).select(F.concat(F.lit("b/x"), k, F.lit("/index.ts")).alias("path"))
    return files.resolve_imports(imports, own.unionByName(index))


@query
def usage_log(spark, sf):
    """Usage rows with long queries, appended to a log and read back."""
    folder = _folder(spark, "usage")
    rows = views.usage(spark, sf).withColumn("ts", F.col("ts") + 1).withColumn("query", F.repeat("query", F.lit(40)))
    if not usage_rows.append_usage(rows, folder):
        raise RuntimeError("the usage log is switched off")
    return usage_rows.read_usage(spark, folder).select("ts", "in_tokens", "out_tokens", "elapsed_ms", "query", "project")


@query
def skeleton_apply(spark, sf):
    """Hinted modules, those of even size, become their skeleton where it is shorter."""
    c = views.code_files(spark, sf).withColumn("skeleton_hint", F.regexp_extract("path", "m([0-9]+)", 1).cast("int") % 2 == 0)
    return pipeline.apply_skeletons(c).select("path", F.md5("content").alias("digest"))


@query
def manifest_upsert(spark, sf):
    part = table(spark, sf, "part")
    row = lambda p, tag, at: p.select(F.concat(F.lit("p"), "p_partkey").alias("path"), F.md5(F.concat(F.lit(tag), "p_partkey")).alias("sha256"), F.lit("python").alias("language"), F.lit(at).cast("long").alias("last_indexed"))
    return store.upsert_files(row(part.where("p_partkey % 5 <> 0"), "a", 1), row(part.where("p_partkey % 7 <> 0"), "b", 2))


@query
def store_snapshot(spark, sf):
    """The graph saved as a snapshot and opened again: rows by table and kind, and the sums of their ids."""
    g = graph(spark, sf).save(_folder(spark, "graph"))
    n = g.nodes.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    e = g.edges.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("src") + F.col("dst")).alias("ids"))
    return n.withColumn("part", F.lit("node")).unionByName(e.withColumn("part", F.lit("edge"))).unionByName(g.files.select(F.lit("file").alias("kind"), F.count("*").over(Window.partitionBy()).alias("n"), F.lit(0).cast("long").alias("ids"), F.lit("file").alias("part")).limit(1))


@query
def point_lookups(spark, sf):
    g = graph(spark, sf)
    found = {"name": g.find("p7"), "qualified": g.by_qualified("n::3"), "file": g.in_file("r/1"), "id": g.by_id(5)}
    out = None
    for how, rows in found.items():
        one = rows.select(F.lit(how).alias("how"), "id", "name")
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- usage and streams


@query
def usage_totals(spark, sf):
    d = reports.totals(reports.of_project(views.usage(spark, sf), "p1"))
    return d.select("runs", "in_tokens", "out_tokens", "saved_tokens", "elapsed_ms", F.round("avg_ms", 6).alias("avg_ms"), F.round("pct", 6).alias("pct"))


@query
def usage_by_query(spark, sf):
    return reports.by_query(views.usage(spark, sf), 5).select("query", "runs", "saved_tokens", "in_tokens", "elapsed_ms", F.round("pct", 6).alias("pct"), "bar")


@query
def session_summary(spark, sf):
    runs = views.usage(spark, sf).select(F.col("in_tokens").alias("original_tokens"), (F.col("out_tokens") * F.when(F.col("ts") % 5 == 0, 4).otherwise(1)).alias("final_tokens"), "elapsed_ms")
    return reports.session_summary(runs).select("runs", "original_tokens", "final_tokens", "saved_tokens", F.round("avg_ms", 6).alias("avg_ms"), F.round("pct", 6).alias("pct"))


@query
def event_filter(spark, sf):
    return table(spark, sf, "pages").select("page_id", watch.watched(F.regexp_replace("url", "/en/", "/target/")).alias("watched"))


@query
def debounce_sessions(spark, sf):
    ev = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id"), F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, "~").otherwise("")).alias("path"), F.lit("modify").alias("op"))
    return watch.debounced(ev, "1 hour", keys=["user_id"]).select("user_id", F.unix_micros("start").alias("start"), F.array_join("paths", ",").alias("paths"))


@query
def watch_stream(spark, sf):
    """The events as files of a stream: debounced bursts of ten minutes, written by a streaming query. An event long after
    all others moves the watermark past them; its own burst stays open."""
    folder = _folder(spark, "events")
    ev = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "~").otherwise("")).alias("path"), F.lit("modify").alias("op"))
    last = ev.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select("ts", F.lit("end").alias("path"), F.lit("modify").alias("op"))
    ev.unionByName(last).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(folder + "/in")
    stream = watch.debounced(watch.read_events(spark, folder + "/in"), "10 minutes")
    run = stream.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(folder + "/out").select(F.unix_micros("start").alias("start"), F.array_join("paths", ",").alias("paths"))


ORACLES = oracles.ORACLES
