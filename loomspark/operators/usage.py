"""Usage reports over the log of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T

NO_QUERY = "(no query)"


def of_project(usage: DataFrame, project: str | None) -> DataFrame:
    """Rows of one project; all rows for None. Rows without a project belong to none."""
    return usage if project is None else usage.where(F.col("project") == project)


def _percent(part, whole):
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def totals(usage: DataFrame) -> DataFrame:
    """One row: runs, in_tokens, out_tokens, saved_tokens, elapsed_ms, avg_ms, pct."""
    z = lambda c, v: F.coalesce(F.sum(c), F.lit(v))
    d = usage.agg(F.count("*").alias("runs"), z("in_tokens", 0).alias("in_tokens"), z("out_tokens", 0).alias("out_tokens"), z("saved_tokens", 0).alias("saved_tokens"), z("elapsed_ms", 0.0).alias("elapsed_ms"))
    return d.withColumn("avg_ms", F.when(F.col("runs") > 0, F.col("elapsed_ms") / F.col("runs")).otherwise(0.0)).withColumn("pct", _percent(F.col("saved_tokens"), F.col("in_tokens")))


def by_query(usage: DataFrame, top: int | None = None, bar_width: int = 20) -> DataFrame:
    """(query, runs, saved_tokens, in_tokens, elapsed_ms, pct, bar): groups by trimmed query, most saved first."""
    q = F.trim(F.coalesce("query", F.lit("")))
    g = usage.groupBy(F.when(q == "", NO_QUERY).otherwise(q).alias("query")).agg(F.count("*").alias("runs"), F.sum("saved_tokens").alias("saved_tokens"), F.sum("in_tokens").alias("in_tokens"), F.sum("elapsed_ms").alias("elapsed_ms"))
    g = g if top is None else g.orderBy(F.desc("saved_tokens"), "query").limit(top)
    most = g.select(F.max("saved_tokens")).scalar()  # one value, aggregated in parts; a window would hold all queries in one task
    return g.withColumn("pct", _percent(F.col("saved_tokens"), F.col("in_tokens"))).withColumn("bar", T.bar(F.when(most > 0, F.col("saved_tokens") / most).otherwise(0.0), bar_width)).orderBy(F.desc("saved_tokens"), "query")


def session_summary(runs: DataFrame) -> DataFrame:
    """One row over runs (original_tokens, final_tokens, elapsed_ms); savings never below zero."""
    saved = F.greatest(F.lit(0), F.col("original_tokens") - F.col("final_tokens"))
    d = runs.agg(F.count("*").alias("runs"), F.coalesce(F.sum("original_tokens"), F.lit(0)).alias("original_tokens"), F.coalesce(F.sum("final_tokens"), F.lit(0)).alias("final_tokens"), F.coalesce(F.sum(saved), F.lit(0)).alias("saved_tokens"), F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("avg_ms"))
    return d.withColumn("pct", _percent(F.col("saved_tokens"), F.col("original_tokens")))
