"""Stripping and boilerplate collapse."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.functions.udfs import strip_code

REPEATS, MIN_BYTES = 4, 24
STRIPPED_KINDS, COLLAPSED_KINDS = ("code", "selection"), ("code", "selection", "doc")


def strip_chunks(chunks: DataFrame, by_patterns: bool = False) -> DataFrame:
    """content stripped of comments and logs in code and selections, where that makes it shorter in bytes."""
    c, lang = F.col("content"), F.col("language")
    stripped = T.strip_by_patterns(c, lang) if by_patterns else F.when(lang.isin("rust", "typescript", "javascript", "python"), strip_code(c, lang)).otherwise(T.tidy_lines(c))
    d = chunks.withColumn("_s", F.when(F.col("kind").isin(*STRIPPED_KINDS), stripped))
    return d.withColumn("content", F.when(F.octet_length("_s") < F.octet_length("content"), F.col("_s")).otherwise(F.col("content"))).drop("_s")


def frequent_lines(chunks: DataFrame, repeats: int = REPEATS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(key, times, first): normalised lines that occur `repeats` times or more, and where they first do in a kind
    that is collapsed. Partial sums meet per digest, so a very frequent line costs one row a task."""
    rows = chunks.select("pos", "kind", F.posexplode(F.transform(T.lines(F.col("content")), T.normalize_whitespace)).alias("line", "norm")).where(F.octet_length("norm") >= min_bytes)
    at = F.when(F.col("kind").isin(*COLLAPSED_KINDS), F.struct("pos", "line"))
    return rows.groupBy(F.md5("norm").alias("key")).agg(F.count("*").alias("times"), F.min(at).alias("first")).where(F.col("times") >= repeats)


def collapse_boilerplate(chunks: DataFrame, repeats: int = REPEATS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Of each frequent line only the first occurrence stays, in rows of the collapsed kinds; below two rows nothing
    happens. Shuffled are line digests and places; content meets only the list of its own lines to drop."""
    if chunks.limit(2).count() < 2:
        return chunks
    frequent = frequent_lines(chunks, repeats, min_bytes)
    rows = chunks.where(F.col("kind").isin(*COLLAPSED_KINDS)).select("pos", F.posexplode(F.transform(T.lines(F.col("content")), T.normalize_whitespace)).alias("line", "norm")).where(F.octet_length("norm") >= min_bytes)
    drop = rows.select("pos", "line", F.md5("norm").alias("key")).join(frequent, "key").where((F.col("first.pos") != F.col("pos")) | (F.col("first.line") != F.col("line")))
    per = drop.groupBy("pos").agg(F.collect_list("line").alias("_drop"))
    kept: Column = F.filter(T.lines(F.col("content")), lambda x, i: ~F.array_contains(F.col("_drop"), i))
    return chunks.join(per, "pos", "left").withColumn("content", F.when(F.col("_drop").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("content"))).select(*chunks.columns)


def line_sketch(chunks: DataFrame, epsilon: float = 0.001, delta: float = 0.0001, seed: int = 42) -> DataFrame:
    """One row: a mergeable Count-Min sketch of all normalised lines, and how many there are."""
    rows = chunks.select(F.explode(F.transform(T.lines(F.col("content")), T.normalize_whitespace)).alias("norm")).where("norm <> ''")
    return rows.agg(F.count_min_sketch("norm", F.lit(epsilon), F.lit(1 - delta), F.lit(seed)).alias("sketch"), F.count("*").alias("total"))


def sketch_shape(epsilon: float = 0.001, delta: float = 0.0001) -> tuple[int, int]:
    """(rows, columns) that keep the overcount below epsilon of the total with probability 1 - delta."""
    import math

    return math.ceil(math.log(1 / delta)), math.ceil(math.e / epsilon)


class CountMin:
    """A small driver-side sketch with the same bounds: add, count, merge; counts saturate at 32 bits."""

    def __init__(self, epsilon: float = 0.001, delta: float = 0.0001):
        import numpy as np

        self.rows, self.cols = sketch_shape(epsilon, delta)
        self.cells, self.total = np.zeros((self.rows, self.cols), np.int64), 0

    def _at(self, item: str):
        import hashlib

        d = int.from_bytes(hashlib.md5(item.encode()).digest(), "little")
        a, b = d & (1 << 64) - 1, d >> 64 | 1
        return [(a + i * b) % (1 << 64) % self.cols for i in range(self.rows)]

    def add(self, item: str, n: int = 1) -> None:
        for i, j in enumerate(self._at(item)):
            self.cells[i, j] = min(self.cells[i, j] + n, (1 << 32) - 1)
        self.total += n

    def count(self, item: str) -> int:
        return int(min(self.cells[i, j] for i, j in enumerate(self._at(item))))

    def merge(self, other: CountMin) -> None:
        self.cells += other.cells
        self.total += other.total

    def clear(self) -> None:
        self.cells[:] = 0
        self.total = 0


@dataclass(frozen=True)
class CompressStats:
    tokens_before: int
    tokens_after: int
    bytes_before: int
    bytes_after: int
    chunks_touched: int


def compress(chunks: DataFrame) -> tuple[DataFrame, CompressStats]:
    """Strip, then collapse. chunks_touched counts all rows."""
    from loomspark.scratch import materialize

    out = materialize(collapse_boilerplate(materialize(strip_chunks(chunks), "stripped")), "compressed")
    sums = [F.coalesce(F.sum(T.estimate_tokens(F.col("content"))), F.lit(0)), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)), F.count("*")]
    a, b = chunks.agg(*sums).first(), out.agg(*sums).first()
    return out, CompressStats(a[0], b[0], a[1], b[1], a[2])
