"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import free, materialize, ready
from loomspark.scratch import global_rank

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
CYCLE = 3
#: Bytes that one range of the ordered documents holds, about.
RANGE_BYTES = 64 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cap: float = CAP, cycle: int = CYCLE) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source.

    Sources by code point, null last, weigh 1, 2, ..., cycle, 1, ...; shares of the total size by weight, but at most
    cap times the source's own size; the excess goes to the others by weight until none is above its cap. The level is
    what a source of weight 1 gets; each round is one sum over the sources below their cap, and caps those that its level
    is too much for. Levels only rise, so a capped source stays capped and the rounds end."""
    ranked = global_rank(sizes.select("source", "source_size"), [F.col("source").isNull(), F.col("source").cast("binary")], "_n")
    s = materialize(ranked.select("source", "source_size", (F.pmod(F.col("_n") - 1, F.lit(cycle)) + 1).cast("double").alias("w"), (F.lit(float(cap)) * F.col("source_size")).alias("most")), "sources")
    level, fixed = -1.0, -1
    while True:
        over = F.lit(level) * F.col("w") > F.col("most")
        got = s.agg(F.sum("source_size"), F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("w"))), F.count(F.when(over, 1))).first()
        if got[3] == fixed or not got[2]:
            break
        level, fixed = (got[0] - (got[1] or 0.0)) / got[2], got[3]
    return s.select("source", "source_size", F.least("most", F.lit(level) * F.col("w")).alias("target"))


def offset_of(source: Column, seed: int) -> Column:
    """The source's random offset in [0, 1): 52 bits of a digest of its name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\\N")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, cap: float = CAP, cycle: int = CYCLE, seed: int = 0) -> DataFrame:
    """docs with size, source_size, target and copies (int): how often the mix takes each row.

    Every row of a source has the same expected copies, target / source_size, so the prefix sum before row k of the
    source is (k - 1) times that. Rows stand in order of size, which spreads the copies evenly over sizes and keeps
    the words taken within about one document of the target. One offset a source is added, and a row is emitted
    once for each integer that the sum crosses, at most cap times.

    Ranks come from one range partitioning by (source, size, hash of doc_id, hash of the text): the position inside a
    partition plus the counts of those before it, so a source may span any number of partitions; their number follows
    the bytes. Rows equal in all four are repeats, and it is open which of them the mix takes. Null texts have size 0,
    null sources are one source, the last. A source of size 0 has target 0 and is not taken; an empty table gives no
    rows. Columns named like the added ones are replaced, all others come back as they are."""
    spark = ready(docs.sparkSession)
    added = {"size", "source_size", "target", "copies"}
    keep = [c for c in docs.columns if c not in added]
    h, t, at, part, first, base, words, p, name, shift, rate, u = free([*keep, *added], "h", "t", "at", "part", "first", "base", "words", "p", "s", "shift", "rate", "u")
    original = [F.col(f"`{c}`") for c in keep]
    text = F.col("text").cast("string")
    has_text = "text" in keep
    sized = docs.select(*original, word_count(text).alias("size") if has_text else F.col("size"), F.md5(F.col("doc_id").cast("string")).alias(h), (F.xxhash64(text) if has_text else F.lit(0)).alias(t))
    if has_text:
        total = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    else:  # counted once, not again for the borders of the ranges
        sized = materialize(sized, "sizes")
        total = (0, sized.count())
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-((total[0] or 0) + 64 * total[1]) // RANGE_BYTES))
    order = [F.col("source").asc_nulls_last(), "size", h, t]
    ordered = sized.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()).drop(h, t)
    ordered = materialize(ordered, "mix")
    partition = F.shiftright(at, 33)
    # a row for each source in each partition: about as many as partitions and sources together
    cells = ordered.groupBy("source", partition.alias(part)).agg(F.count("*").alias("n"), F.min(at).alias(first), F.sum("size").alias(words))
    run = Window.partitionBy("source").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn(base, F.coalesce(F.sum("n").over(run), F.lit(0))), "cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum(words).alias("source_size")), cap, cycle)
    plan = cells.select("source", part, first, base).alias("a").join(targets.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select(
        F.col(part).alias(p), F.col("a.source").alias(name), (F.col(base) - F.col(first)).alias(shift), "source_size", "target",
        (F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).alias(rate), offset_of(F.col("a.source"), seed).alias(u))
    k = F.col(at) + F.col(shift)
    copies = (F.floor((k + 1) * F.col(rate) + F.col(u)) - F.floor(k * F.col(rate) + F.col(u))).cast("int")
    out = ordered.withColumn(part, partition).join(plan, (F.col(part) == F.col(p)) & F.col("source").eqNullSafe(F.col(name)))
    return out.select(*original, "size", "source_size", "target", F.least(copies, F.lit(int(cap))).alias("copies"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, each row as often as the mix takes it. Also columns that mix() would replace come
    back as they are."""
    held = {c: n for c, n in zip(docs.columns, free(docs.columns, *docs.columns)) if c in ("size", "source_size", "target", "copies")}
    got = mix(docs.withColumnsRenamed(held), **options)
    back = [F.col(held.get(c, f"`{c}`")).alias(c) for c in docs.columns]
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return got.where("copies > 0").select(*back, copies.alias(free(docs.columns, "copy")[0])).select(*[F.col(f"`{c}`") for c in docs.columns])
