"""Communities by modularity: local moves in order of id, exact within each connected component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.components import connected_components
from loomspark.scratch import global_rank, materialize, ready

PASSES, LEAST_GAIN = 50, 1e-12
#: Rows of a batch of labels.
ROWS = 65536


def symmetric(edges: DataFrame) -> DataFrame:
    """(a, b, w), both ways: confidences of all edges between two different nodes, summed."""
    e = edges.where("src <> dst").select("src", "dst", F.greatest("confidence", F.lit(0.0)).alias("w")).where("w > 0")
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


def _both_ways(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first, to, w): links a-b, given once each, as lists of neighbours: those of ids[i] are at first[i] to first[i + 1]."""
    ids = np.union1d(a, b)
    n = len(ids)
    a, b = np.searchsorted(ids, a).astype(np.int32), np.searchsorted(ids, b).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n))])
    key = np.concatenate([a.astype(np.int64) * n + b, b.astype(np.int64) * n + a])
    del a, b
    order = np.argsort(key)
    half = len(w)
    w = w[np.where(order < half, order, order - half)]
    key = key[order]
    del order
    key %= n
    return ids, first, key.astype(np.int32), w


def _moves(first: np.ndarray, to: np.ndarray, w: np.ndarray, m: float, passes: int) -> list[int]:
    """The label (a place) of each node. Links stay in arrays; only one node's are ever objects."""
    first = first.tolist()
    n = len(first) - 1
    label = list(range(n))
    degree = [sum(w[first[i] : first[i + 1]].tolist()) for i in range(n)]
    total = list(degree)
    for _ in range(passes):
        moved = False
        for i, k in enumerate(degree):
            inside: dict[int, float] = {}
            for j, x in zip(to[first[i] : first[i + 1]].tolist(), w[first[i] : first[i + 1]].tolist()):
                c = label[j]
                inside[c] = inside.get(c, 0.0) + x
            own = label[i]
            leave = inside.get(own, 0.0) - (total[own] - k) * k / (2 * m)
            best, gain = own, 0.0
            for c in sorted(inside):
                g = (inside[c] - total[c] * k / (2 * m) - leave) / m
                if c != own and g > gain + LEAST_GAIN:
                    best, gain = c, g
            if best != own:
                total[own] -= k
                total[best] += k
                label[i] = best
                moved = True
        if not moved:
            break
    return label


def local_moves(a: np.ndarray, b: np.ndarray, w: np.ndarray, m: float, passes: int = PASSES) -> dict[int, int]:
    """Label (an id) of each node of one component with links a-b of weight w both ways; m: half the whole graph's
    degree. Of equally good moves the one to the least label is made."""
    once = a < b
    ids, first, to, w = _both_ways(a[once], b[once], w[once])
    return dict(zip(ids.tolist(), ids[_moves(first, to, w, m, passes)].tolist()))


def louvain(nodes: DataFrame, edges: DataFrame, passes: int = PASSES) -> DataFrame:
    """(id, community): dense labels by first appearance in order of id; nodes without links are alone.

    A move looks at a node's neighbours, their labels' degrees and the constant m, so components are independent
    groups; links travel once each, as three numbers, in Arrow batches, and are held as arrays of 24 bytes a link. The
    order of moves within a component is part of the result."""
    ready(nodes.sparkSession)
    links = materialize(symmetric(edges), "links")
    m = (links.agg(F.sum("w")).first()[0] or 0.0) / 2
    comp = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[x.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "w")] for x in batches]
        ids, first, to, w = _both_ways(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        parts.clear()
        raw = ids[_moves(first, to, w, m, passes)]
        for lo in range(0, len(ids), ROWS):
            yield pa.RecordBatch.from_pydict({"id": ids[lo : lo + ROWS], "raw": raw[lo : lo + ROWS]})

    raw = links.where("a < b").join(comp.withColumnRenamed("id", "a"), "a").groupBy("component").applyInArrow(run, "id long, raw long")
    raw = nodes.select("id").distinct().join(materialize(raw, "labels"), "id", "left").select("id", F.coalesce("raw", "id").alias("raw"))
    firsts = global_rank(raw.groupBy("raw").agg(F.min("id").alias("_first")), [F.asc("_first")], "_n")
    return raw.join(firsts, "raw").select("id", (F.col("_n") - 1).cast("int").alias("community"))


def modularity(edges: DataFrame, labels: DataFrame, textbook: bool = False) -> float:
    """Over adjacent pairs of one community only, or, textbook, over all pairs of one community."""
    links = materialize(symmetric(edges), "links")
    degree = links.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    two_m = degree.agg(F.sum("k")).first()[0] or 0.0
    if not two_m:
        return 0.0
    d = degree.join(labels, "id")
    pair = links.join(d.select(F.col("id").alias("a"), F.col("k").alias("ka"), F.col("community").alias("ca")), "a").join(d.select(F.col("id").alias("b"), F.col("k").alias("kb"), F.col("community").alias("cb")), "b").where("ca = cb")
    if textbook:
        inside = pair.agg(F.sum("w")).first()[0] or 0.0
        spread = d.groupBy("community").agg(F.sum("k").alias("k")).agg(F.sum(F.pow("k", F.lit(2.0)))).first()[0]
        return inside / two_m - spread / two_m**2
    return (pair.agg(F.sum(F.col("w") - F.col("ka") * F.col("kb") / F.lit(two_m))).first()[0] or 0.0) / two_m
