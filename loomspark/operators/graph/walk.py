"""PageRank, its personalised form, and random walks with restart: one power iteration over joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.scratch import local_arrays, materialize

DAMPING, RESTART, ROUNDS, TOLERANCE = 0.85, 0.5, 50, 1e-6
TOP_RWR = 1024


def _power_arrays(spark, links, teleport, keep: float, rounds: int, tolerance: float | None) -> DataFrame:
    """The same iteration where links and nodes passed the size check."""
    ids = teleport["id"].to_numpy()
    order = np.argsort(ids)
    ids, v = ids[order], teleport["v"].to_numpy()[order]
    src, dst = (np.searchsorted(ids, links[c].to_numpy()) for c in ("src", "dst"))
    out = np.bincount(src, minlength=len(ids))
    score = v.copy()
    for _ in range(rounds):
        walked = np.bincount(dst, weights=score[src] / out[src], minlength=len(ids))
        new = keep * (walked + score[out == 0].sum() * v) + (1 - keep) * v
        change, score = np.abs(new - score).sum(), new
        if tolerance is not None and change < tolerance:
            break
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "score": pa.array(score, pa.float64())}))


def _power(nodes: DataFrame, edges: DataFrame, teleport: DataFrame, keep: float, rounds: int, tolerance: float | None, arrays: bool = True) -> DataFrame:
    """(id, score): score = keep * (walks in + dangling mass * v) + (1 - keep) * v until the L1 change is below tolerance.

    teleport (id, v) holds every node; a round joins ranks to out-edges, sums per target and is written once, with the
    round's change and dangling mass summed from it. With `arrays`, graphs below scratch.LOCAL_EDGES are iterated over as arrays,
    to the same scores."""
    known = nodes.select("id").distinct()
    links = edges.select("src", "dst").join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    links = materialize(links, "links")
    small = (local_arrays(links), local_arrays(teleport.select("id", "v"))) if arrays else (None, None)
    if small[0] is not None and small[1] is not None:
        return _power_arrays(links.sparkSession, *small, keep, rounds, tolerance)
    out = links.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    base = materialize(teleport.join(out, "id", "left").select("id", "v", F.coalesce("out", F.lit(0)).alias("out")), "base")
    cur = base.select("id", "v", "out", F.col("v").alias("score"))
    loose = base.agg(F.sum(F.when(F.col("out") == 0, F.col("v")))).first()[0] or 0.0
    for _ in range(rounds):
        inflow = links.join(cur.where("out > 0").select(F.col("id").alias("src"), (F.col("score") / F.col("out")).alias("w")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("w"))
        score = F.lit(keep) * (F.coalesce("w", F.lit(0.0)) + F.lit(loose) * F.col("v")) + F.lit(1 - keep) * F.col("v")
        nxt = materialize(cur.join(inflow, "id", "left").select("id", "v", "out", score.alias("score"), F.col("score").alias("_was")), "ranks")
        row = nxt.agg(F.sum(F.abs(F.col("score") - F.col("_was"))), F.sum(F.when(F.col("out") == 0, F.col("score")))).first()
        cur, loose = nxt.drop("_was"), row[1] or 0.0
        if tolerance is not None and (row[0] or 0.0) < tolerance:
            break
    return cur.select("id", "score")


def uniform(nodes: DataFrame) -> DataFrame:
    n = nodes.select("id").distinct().count()
    return nodes.select("id").distinct().withColumn("v", F.lit(1.0 / max(n, 1)))


def _seeded(nodes: DataFrame, seeds: DataFrame, distinct: bool) -> DataFrame:
    """Teleport to the known seeds (id); to every node where none is known.

    distinct: a repeated seed counts once. Otherwise repeats raise the seed count, and the mass falls below 1."""
    known = nodes.select("id").distinct()
    mine = materialize(seeds.select("id").join(known, "id", "left_semi"), "seeds")
    n = (mine.distinct() if distinct else mine).count()
    if not n:
        return uniform(nodes)
    return known.join(mine.distinct().withColumn("_s", F.lit(1.0 / n)), "id", "left").select("id", F.coalesce("_s", F.lit(0.0)).alias("v"))


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, arrays: bool = True) -> DataFrame:
    """(id, score) over edges of all kinds; parallel edges of different kinds count apart. seeds personalise it."""
    v = uniform(nodes) if seeds is None else _seeded(nodes, seeds, True)
    return _power(nodes, edges, v, damping, rounds, tolerance, arrays)


def random_walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = RESTART, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, arrays: bool = True) -> DataFrame:
    """(id, score) of a walk from the seeds that goes on with probability alpha."""
    return _power(nodes, edges, _seeded(nodes, seeds, False), alpha, rounds, tolerance, arrays)


def weighted_walk(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = RESTART, rounds: int = ROUNDS, tolerance: float | None = TOLERANCE, arrays: bool = True) -> DataFrame:
    """The same from weighted seeds (id, weight), whose weights are normalised."""
    known = nodes.select("id").distinct()
    w = materialize(seeds.join(known, "id", "left_semi").groupBy("id").agg(F.sum("weight").alias("w")), "seeds")
    total = w.agg(F.sum("w")).first()[0] or 0.0
    v = uniform(nodes) if total <= 0 else known.join(w, "id", "left").select("id", (F.coalesce("w", F.lit(0.0)) / F.lit(total)).alias("v"))
    return _power(nodes, edges, v, alpha, rounds, tolerance, arrays)


def top(scores: DataFrame, k: int, pool: DataFrame | None = None) -> DataFrame:
    """The k best of scores, or of pool (id) by scores; ties by id."""
    s = scores if pool is None else pool.select("id").distinct().join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return s.orderBy(F.desc("score"), "id").limit(k)
