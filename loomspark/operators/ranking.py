"""Ranking: BM25, density, relevance feedback and reciprocal rank fusion with priors.

Scores are per-row sums of joins with small tables; ranks come from range exchanges (see scratch.global_rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.scratch import BROADCAST_ROWS, global_rank, materialize, small

K1, B = 1.5, 0.75
RRF_K = 60
FEEDBACK_DOCS, FEEDBACK_TERMS, FEEDBACK_ALPHA, QUERY_REPEATS = 5, 8, 0.3, 10
#: Weights of BM25, density and prior, with a query and without one.
WEIGHTS, WEIGHTS_NO_QUERY = (1.5, 0.7, 1.0), (0.0, 1.5, 1.0)
DIGITS = 12
#: Rarities are summed as two whole numbers of 2**-FRACTION and 2**-(2 * FRACTION), so that no order of rows changes a sum.
FRACTION = 30


class Corpus:
    """Term statistics of chunks: docs (pos, dl), df (t, df), and the scalars n and avgdl. Tokens stay with their row;
    only counts a task and term are shuffled."""

    def __init__(self, chunks: DataFrame):
        tokens = T.tokenize_words(F.col("content"))
        both = materialize(chunks.select("pos", tokens.alias("tokens")), "tokens")
        self.docs = both.select("pos", F.size("tokens").cast("long").alias("dl"))
        self.df = both.select(F.explode(F.array_distinct("tokens")).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        row = self.docs.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        self.n, self.avgdl = row.n, row.avgdl or 0.0
        self._tokens = both

    def tf_of(self, terms: DataFrame) -> DataFrame:
        """(pos, dl, t, tf) of the given few terms only: other tokens are dropped before the shuffle."""
        rows = self._tokens.select("pos", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("t"))
        return rows.join(small(terms.select("t")), "t", "left_semi").groupBy("pos", "t").agg(F.first("dl").alias("dl"), F.count("*").alias("tf"))


def query_terms(spark: SparkSession, query: str | None) -> DataFrame:
    """(t, times): the query's terms; a repeated term counts repeatedly."""
    one = spark.createDataFrame([(query or "",)], "q string")
    return one.select(F.explode(T.tokenize_words(F.col("q"))).alias("t")).groupBy("t").agg(F.count("*").alias("times"))


def bm25(corpus: Corpus, terms: DataFrame) -> DataFrame:
    """(pos, score) for every row of the corpus, from terms (t, times)."""
    tf = materialize(corpus.tf_of(terms), "tf")
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    idf = F.ln((F.lit(float(corpus.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    norm = F.lit(1.0 - B) + F.lit(B) * F.col("dl") / F.lit(max(corpus.avgdl, 1.0))
    hit = tf.join(small(df.join(terms, "t").select("t", (F.col("times") * idf).alias("w"))), "t")
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    # decimals: the few parts of a row add up to the same in any order
    score = hit.groupBy("pos").agg(F.sum(part.cast("decimal(28,18)")).cast("double").alias("s"))
    return corpus.docs.select("pos").join(score, "pos", "left").select("pos", T.round_binary(F.coalesce("s", F.lit(0.0)), DIGITS).alias("score"))


def density(corpus: Corpus) -> DataFrame:
    """(pos, score): sum over a row's terms of their share times smoothed rarity; 0 for rows without terms.

    That is the mean rarity of the row's tokens. The most frequent terms, BROADCAST_ROWS at most, meet the tokens by
    broadcast, so no term has many rows in a shuffle; where there are more terms, the rest follow by a join of their
    counts in each row. Sums are of whole numbers: rows of equal tokens have equal scores, in whatever order they come."""
    w = (F.ln(F.lit(float(corpus.n + 1)) / (F.col("df") + 1.0)) + 1.0) * F.lit(float(1 << FRACTION))
    rarity = [F.floor(w).alias("w"), F.floor((w - F.floor(w)) * F.lit(float(1 << FRACTION))).alias("v")]
    both = [F.sum("w").alias("w"), F.sum("v").alias("v")]
    df = materialize(corpus.df, "df")
    often = df.orderBy(F.desc("df"), "t").limit(BROADCAST_ROWS)
    tokens = corpus._tokens.select("pos", F.size("tokens").alias("dl"), F.explode("tokens").alias("t"))
    parts = [tokens.join(F.broadcast(often.select("t", *rarity)), "t").groupBy("pos", "dl").agg(*both)]
    if df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        rare = tokens.join(F.broadcast(often.select("t")), "t", "left_anti").groupBy("pos", "dl", "t").agg(F.count("*").alias("tf"))
        parts.append(rare.join(df.select("t", *rarity), "t").select("pos", "dl", (F.col("tf") * F.col("w")).alias("w"), (F.col("tf") * F.col("v")).alias("v")))
    one = F.lit(2.0**-FRACTION)
    s = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).groupBy("pos").agg(((F.sum("w") * one + F.sum("v") * one * one) / F.first("dl")).alias("s"))
    return corpus.docs.select("pos").join(s, "pos", "left").select("pos", T.round_binary(F.coalesce("s", F.lit(0.0)), DIGITS).alias("score"))


def feedback_terms(corpus: Corpus, terms: DataFrame, docs: int = FEEDBACK_DOCS, n: int = FEEDBACK_TERMS) -> DataFrame:
    """(t, weight): the terms that weigh most in the best documents and aren't in the query; none without a match."""
    top = bm25(corpus, terms).where("score > 0").orderBy(F.desc("score"), "pos").limit(docs)
    share = top.withColumn("p", F.col("score") / F.sum("score").over(Window.partitionBy(F.lit(1))))  # at most `docs` rows
    rows = corpus._tokens.join(F.broadcast(share.select("pos", "p")), "pos").select("p", F.size("tokens").alias("dl"), F.explode("tokens").alias("t"))
    weight = rows.groupBy("t").agg(T.round_binary(F.sum(F.col("p") / F.col("dl")), DIGITS).alias("weight"))
    return weight.join(F.broadcast(terms.select("t")), "t", "left_anti").orderBy(F.desc("weight"), "t").limit(n)


def expand_query(corpus: Corpus, terms: DataFrame, docs: int = FEEDBACK_DOCS, n: int = FEEDBACK_TERMS, alpha: float = FEEDBACK_ALPHA) -> DataFrame:
    """(t, times): the query's terms ten times each, feedback terms in proportion to alpha; unchanged where none match."""
    a = min(max(alpha, 0.05), 0.95)
    repeats = max(1, int(a / (1 - a) * QUERY_REPEATS + 0.5))
    extra = materialize(feedback_terms(corpus, terms, docs, n).select("t", F.lit(repeats).cast("long").alias("times")), "feedback")
    if not extra.limit(1).count() and not bm25(corpus, terms).where("score > 0").limit(1).count():
        return terms
    return terms.select("t", (F.col("times") * QUERY_REPEATS).alias("times")).unionByName(extra)


def expand_raw_query(corpus: Corpus, query: str) -> DataFrame:
    return expand_query(corpus, query_terms(corpus.docs.sparkSession, query))


def rank_by_score(scores: DataFrame, name: str = "rank") -> DataFrame:
    """scores (pos, score) plus the 1-based rank: score descending, then position."""
    return global_rank(scores, [F.desc("score"), F.asc("pos")], name)


def rank_from_priors(chunks: DataFrame, priors: DataFrame) -> DataFrame:
    """(pos, score, rank) by priors (id, prior); rows without one have 0."""
    best = priors.groupBy("id").agg(F.max("prior").alias("prior"))
    return rank_by_score(chunks.select("id", "pos").join(best, "id", "left").select("pos", F.coalesce("prior", F.lit(0.0)).alias("score")))


def reciprocal(rank: Column, weight: float = 1.0, k: int = RRF_K) -> Column:
    return F.coalesce(F.lit(weight) / (F.lit(float(k)) + rank), F.lit(0.0))


def rrf(rankings: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """(pos, score): weighted reciprocal ranks of (pos, rank) tables; rows that a ranking lacks get nothing from it."""
    parts = None
    for df, weight in rankings:
        one = df.select("pos", reciprocal(F.col("rank"), weight, k).alias("r"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("pos").agg(F.sum("r").alias("score"))


def structural_bump(kind: Column, priority: Column) -> Column:
    by_kind = F.when(kind == "selection", 5.0).when(kind == "diagnostic", 2.0).when(kind == "doc", -0.5).when(kind == "comment", -1.0).otherwise(0.0)
    return (priority + by_kind) / F.lit(float(RRF_K))


def rank(chunks: DataFrame, query: str | None = None, priors: DataFrame | None = None, feedback: bool = False) -> DataFrame:
    """chunks plus score and rank (1-based).

    BM25, density and priors are ranked apart and fused; a ranker takes part only if its best score is above 0, BM25
    only with query terms. Fewer than two rows keep their order and get score 0."""
    if chunks.limit(2).count() < 2:
        return chunks.withColumn("score", F.lit(0.0)).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("pos")).cast("long"))
    spark = chunks.sparkSession
    corpus = Corpus(chunks)
    terms = query_terms(spark, query)
    has_query = terms.limit(1).count() > 0
    if has_query and feedback:
        terms = expand_query(corpus, terms)
    weights = WEIGHTS if has_query else WEIGHTS_NO_QUERY
    lists = []
    scored = [(bm25(corpus, terms), weights[0])] if has_query else []
    scored.append((density(corpus), weights[1]))
    if priors is not None:
        best = priors.groupBy("id").agg(F.max("prior").alias("prior"))
        scored.append((chunks.select("id", "pos").join(best, "id", "left").select("pos", F.coalesce("prior", F.lit(0.0)).alias("score")), weights[2]))
    for scores, weight in scored:
        scores = materialize(scores, "scores")
        top = scores.agg(F.max("score")).first()[0]
        if top is not None and top > 0 and weight > 0:
            lists.append((rank_by_score(scores), weight))
    fused = rrf(lists) if lists else chunks.select("pos", F.lit(0.0).alias("score"))
    total = chunks.select("pos", "kind", "priority").join(fused, "pos", "left").select("pos", T.round_binary(F.coalesce("score", F.lit(0.0)) + structural_bump(F.col("kind"), F.col("priority")), DIGITS).alias("score"))
    return chunks.join(rank_by_score(total), "pos")
