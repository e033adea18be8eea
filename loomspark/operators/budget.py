"""Fitting ranked rows into a token budget, one group a request; and the stable output order."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.model import STRATEGIES
from loomspark.operators import kernels
from loomspark.scratch import materialize, ready


@dataclass(frozen=True)
class BudgetStats:
    kept: int
    dropped: int
    final_tokens: int
    strategy: str


def select_many(ranked: DataFrame, budget: int, strategy: str = "auto", trade: float = 0.7, communities: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept rows, stats) for every request of ranked (request_id, rank, content, community, ...).

    The choice is sequential within a request, so a request is a group, in one task; it holds ranks, costs and line hashes
    only. Rows too big for any state of the budget stay in it: the strategy, the share of new lines and the count of
    dropped rows depend on them. stats has request_id, kept, dropped, final_tokens, strategy."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    ready(ranked.sparkSession)
    lines = F.transform(T.line_set(F.col("content")), lambda x: F.xxhash64(x)) if strategy in ("auto", "mmr_submodular") else F.array().cast("array<bigint>")
    slim = ranked.select("request_id", F.col("rank").cast("long").alias("rank"), T.estimate_tokens(F.col("content")).alias("cost"), F.coalesce("community", F.lit(-1)).cast("long").alias("community"), lines.alias("lines"))

    def choose(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank", ignore_index=True)
        costs = g["cost"].to_numpy(np.int64)
        community = g["community"].to_numpy(np.int64) if communities else None
        kept, dropped, label = kernels.select(strategy, costs, budget, lambda: [np.asarray(x, np.int64) for x in g["lines"]], trade, community)
        rows = g.loc[kept, ["request_id", "rank", "cost"]].assign(dropped=0, strategy=label)
        # one row of rank 0 carries the group's figures
        head = pd.DataFrame({"request_id": [key[0]], "rank": [0], "cost": [int(costs[kept].sum())], "dropped": [dropped], "strategy": [label]})
        return pd.concat([head, rows], ignore_index=True)

    kind = ranked.schema["request_id"].dataType.simpleString()
    got = materialize(slim.groupBy("request_id").applyInPandas(choose, f"request_id {kind}, rank long, cost long, dropped long, strategy string"), "selected")
    kept = ranked.join(got.where("rank > 0").select("request_id", "rank"), ["request_id", "rank"], "left_semi")
    counts = got.groupBy("request_id").agg(F.sum((F.col("rank") > 0).cast("long")).alias("kept"), F.max("dropped").alias("dropped"), F.max(F.when(F.col("rank") == 0, F.col("cost"))).alias("final_tokens"), F.max("strategy").alias("strategy"))
    return kept, counts


def select(ranked: DataFrame, budget: int, strategy: str = "auto", trade: float = 0.7, communities: bool = False) -> tuple[DataFrame, BudgetStats]:
    """The rows of one request, ranked (rank, content, community), that the budget takes."""
    kept, stats = select_many(ranked.withColumn("request_id", F.lit(0)), budget, strategy, trade, communities)
    row = stats.first()
    if row is None:  # no rows
        label = kernels.select(strategy, np.zeros(0, np.int64), budget, list, trade, None)[2]
        return ranked.limit(0), BudgetStats(0, 0, 0, label)
    return kept.drop("request_id"), BudgetStats(row.kept, row.dropped, row.final_tokens, row.strategy)


def cache_order(chunks: DataFrame, tie: str = "rank") -> DataFrame:
    """chunks sorted by a stable hash of id (of content where id is empty), then id, then `tie`: equal sets of rows
    come out in the same order whatever order they came in."""
    key = F.when(F.coalesce("id", F.lit("")) == "", F.col("content")).otherwise(F.col("id"))
    return chunks.orderBy(T.stable_hash(key), "id", *[tie] if tie in chunks.columns else [])
