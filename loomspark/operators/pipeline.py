"""The whole reduction of a request: skeletons, de-duplication, compression, ranking, budget, stable order."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.udfs import skeleton_code
from loomspark.model import Config
from loomspark.operators import budget, compress, dedup, ranking
from loomspark.scratch import materialize


@dataclass(frozen=True)
class Result:
    chunks: DataFrame
    original_tokens: int
    final_tokens: int
    tokens_saved: int
    reduction_pct: float
    elapsed_ms: float
    stats: dict = field(default_factory=dict)

    def frame(self) -> DataFrame:
        """One row of the figures."""
        row = (self.original_tokens, self.final_tokens, self.tokens_saved, self.reduction_pct, self.elapsed_ms)
        return self.chunks.sparkSession.createDataFrame([row], "original_tokens long, final_tokens long, tokens_saved long, reduction_pct double, elapsed_ms double")


def apply_skeletons(chunks: DataFrame) -> DataFrame:
    """Hinted rows become their skeleton where it has fewer bytes."""
    d = chunks.withColumn("_s", F.when(F.col("skeleton_hint"), skeleton_code(F.col("content"), F.col("language"))))
    return d.withColumn("content", F.when(F.octet_length("_s") < F.octet_length("content"), F.col("_s")).otherwise(F.col("content"))).drop("_s")


def skeleton_stats(before: DataFrame, after: DataFrame) -> dict:
    """Figures of the rows whose content changed."""
    both = before.select("pos", F.col("content").alias("_a")).join(after.select("pos", F.col("content").alias("_b")), "pos").where("_a <> _b")
    r = both.agg(F.count("*"), F.coalesce(F.sum(T.estimate_tokens(F.col("_a"))), F.lit(0)), F.coalesce(F.sum(T.estimate_tokens(F.col("_b"))), F.lit(0))).first()
    return {"chunks": r[0], "tokens_before": r[1], "tokens_after": r[2]}


def tokens(chunks: DataFrame) -> int:
    return chunks.agg(F.coalesce(F.sum(T.estimate_tokens(F.col("content"))), F.lit(0))).first()[0]


def arithmetic(original: int, final: int) -> tuple[int, float]:
    """(saved, percentage): never below zero, zero where there was nothing."""
    saved = max(0, original - final)
    return saved, saved / original * 100 if original else 0.0


def optimize(chunks: DataFrame, query: str | None = None, config: Config = Config(), priors: DataFrame | None = None) -> Result:
    """Reduces chunks (the CHUNK schema) to what the budget holds. Each stage is written once and read by the next."""
    began = time.time()
    cur, stats = materialize(chunks, "chunks"), {}
    original = tokens(cur)
    if config.skeleton:
        after = materialize(apply_skeletons(cur), "skeletons")
        stats["skeleton"] = skeleton_stats(cur, after)
        cur = after
    if config.dedup:
        cur, s = dedup.dedup(cur, config.dedup_similarity)
        stats["dedup"] = asdict(s)
    if config.compress:
        cur, s = compress.compress(cur)
        stats["compress"] = asdict(s)
    cur = ranking.rank(cur, query, priors, config.rm3) if config.rank else ranking.global_rank(cur.withColumn("score", F.lit(0.0)), [F.asc("pos")], "rank")
    cur = materialize(cur, "ranked")
    total = tokens(cur)
    if config.budget:
        cur, b = budget.select(cur, config.max_tokens, config.strategy, config.mmr_lambda, config.community_budget)
        cur = materialize(cur, "kept")
    else:
        n = cur.count()
        b = budget.BudgetStats(n, 0, total, "disabled")
    stats["budget"] = asdict(b)
    out = budget.cache_order(cur) if config.cache_order else cur.orderBy("rank")
    final = max(b.final_tokens, tokens(cur))
    saved, pct = arithmetic(original, final)
    return Result(out, original, final, saved, pct, (time.time() - began) * 1000, stats)


class Engine:
    """optimize() under one configuration."""

    def __init__(self, config: Config = Config()):
        self.config = config

    def optimize(self, chunks: DataFrame, query: str | None = None) -> Result:
        return optimize(chunks, query, self.config)

    def optimize_with_priors(self, chunks: DataFrame, query: str | None, priors: DataFrame) -> Result:
        return optimize(chunks, query, self.config, priors)
